"""String and JSON functions as Column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space as Python's str.strip and str.isspace see it; also what RE2 accepts.
SPACE = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]"
#: The same characters one by one, for trimming without a pattern.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


#: Ends of lines as Python's str.splitlines sees them.
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_u(c) -> Column:
    """Strips Unicode white space at both ends."""
    return F.btrim(col(c), F.lit(SPACES))


def is_blank(c) -> Column:
    return F.coalesce(strip_u(c), F.lit("")) == ""


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Compatibility composition, for which Spark has no function; Arrow batches."""
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x), na_action="ignore")


def normalize(c, compose: bool = True) -> Column:
    """Letters and digits only, lower case, after NFKC (unless the text is known to be composed).

    ASCII texts, which NFKC leaves as they are, do not travel to Python.
    """
    c = col(c)
    if compose:
        c = F.coalesce(nfkc(F.when(~c.rlike(r"^\p{ASCII}*$"), c)), c)
    return F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]+", ""))


def first_truthy(*cols) -> Column:
    """The first value that is neither null nor the empty string (strings that come from JSON: "0" counts)."""
    return F.coalesce(*(F.nullif(col(c), F.lit("")) for c in cols))


def clean_text(c) -> Column:
    """Lines stripped, blank lines dropped."""
    lines = F.transform(F.split(col(c), LINE_END, -1), strip_u)
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def drop_blank(items) -> Column:
    return F.filter(F.coalesce(col(items), F.array().cast("array<string>")), lambda x: x.isNotNull() & ~is_blank(x))


def bigrams(c) -> Column:
    """Distinct character pairs without white space; the whole text if shorter than two."""
    z = F.regexp_replace(col(c), f"{SPACE}+", "")

    def pairs(chars: Column) -> Column:
        n = F.greatest(F.size(chars) - 1, F.lit(0))
        return F.array_distinct(F.zip_with(F.slice(chars, 1, n), F.slice(chars, 2, n), lambda p, q: F.concat(p, q)))

    # the characters are taken once (a substring at each place would walk the text each time)
    return F.when(F.length(z) < 2, F.array(z)).otherwise(bound(F.regexp_extract_all(z, F.lit("(?s)."), 0), pairs))


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def bigram_jaccard(a, b) -> Column:
    """Share of common character pairs, case-sensitive; 0 where both are empty or one is null."""

    def share(s: Column) -> Column:
        both = F.size(F.array_intersect(s["x"], s["y"]))
        empty = (F.get(s["x"], F.lit(0)) == "") & (F.get(s["y"], F.lit(0)) == "")
        return F.when(empty, 0.0).otherwise(both.cast("double") / (F.size(s["x"]) + F.size(s["y"]) - both))

    return F.coalesce(F.when(col(a).isNotNull() & col(b).isNotNull(), bound(F.struct(bigrams(a).alias("x"), bigrams(b).alias("y")), share)), F.lit(0.0))


def json_slice(c) -> Column:
    """The part from the first ``{`` to the last ``}``, fences and chatter left out; null if there is none."""
    return F.nullif(F.regexp_extract(col(c), r"(?s)\{.*\}", 0), F.lit(""))


def extract_json(c) -> Column:
    """The JSON object in a reply as VARIANT; null if there is none or it does not parse."""
    v = F.try_parse_json(json_slice(c))
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), v)


def entity_text(v) -> Column:
    """Text of a VARIANT that is a string or an array of strings and {_text | text}; else empty."""
    v = col(v)
    parts = F.try_variant_get(v, "$", "array<variant>")
    one = lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")).otherwise(
        F.coalesce(first_truthy(F.try_variant_get(x, "$._text", "string"), F.try_variant_get(x, "$.text", "string")), F.lit(""))
    )
    kind = F.schema_of_variant(v)
    return F.when(kind == "STRING", F.try_variant_get(v, "$", "string")).when(kind.startswith("ARRAY"), F.array_join(F.transform(parts, one), "")).otherwise("")


def flatten_items(v) -> Column:
    """Stripped non-blank strings of a VARIANT array of strings and {content}."""
    parts = F.coalesce(F.try_variant_get(col(v), "$", "array<variant>"), F.array().cast("array<variant>"))
    one = lambda x: strip_u(F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")).otherwise(F.try_variant_get(x, "$.content", "string")))
    return drop_blank(F.transform(parts, one))


#: What separates the words of a title, and the speaker mark before quoted evidence.
TITLE_BREAKS = r"[\s，。！？、/·（）()]+"
QUOTED = r"(?:她|他|用户)?[:：]\s*(.{2,12})"


def split_keys(title, evidence) -> Column:
    """Up to four trigger words: the title's of 1 to 12 characters, then one fragment of the evidence."""
    title, evidence = col(title), F.coalesce(col(evidence), F.lit(""))
    words = F.filter(F.split(strip_u(title), TITLE_BREAKS), lambda k: F.length(k).between(1, 12))
    piece = F.regexp_replace(F.regexp_extract(evidence, QUOTED, 1), r"[^\p{L}\p{N}_]", "")
    keys = F.when(F.length(piece).between(2, 12) & ~F.array_contains(words, piece), F.array_append(words, piece)).otherwise(words)
    return F.when(F.size(keys) > 0, F.slice(keys, 1, 4)).otherwise(F.array(F.substring(strip_u(title), 1, 12)))


def contained_names(text, names) -> Column:
    """Which of an array of names occur in a text."""
    text = col(text)
    return F.filter(col(names), lambda n: F.contains(text, n))


def split_words(c) -> Column:
    """Non-blank words between white space."""
    return F.filter(F.split(F.coalesce(col(c), F.lit("")), f"{SPACE}+"), lambda k: k != "")
