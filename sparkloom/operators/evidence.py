"""Evidence: quotes must be found in the text they claim to come from."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.batches import parts
from ..functions.needles import Needles
from ..functions.text import col, normalize, strip_u

#: Quotes are looked up in sets of at most this many characters a pass.
QUOTE_CHARS = 16 << 20


def verify_evidence(evidence: DataFrame, messages: DataFrame, keys: list[str], compose: bool = True, min_chars: int = 2) -> DataFrame:
    """``evidence`` (keys, quote, message_index) with status and kept_index.

    A quote is ``kept`` at its index if that message holds it, at 0 if only the
    whole block (messages without separator) does, else ``dropped``; so are quotes
    under ``min_chars`` and without letters or digits. A null index counts as 0, one
    that is no number as none. ``messages`` (keys, idx, content) of a block are
    gathered, which the block's size bounds.
    """
    blocks = messages.select(*keys, F.struct(F.col("idx").cast("int").alias("idx"), normalize("content", compose).alias("t")).alias("m")).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list("m")), lambda m: m["t"]).alias("__texts"))
    quotes = evidence.withColumn("__quote", strip_u("quote")).withColumn("__norm", normalize("__quote", compose))
    index = F.when(F.col("message_index").isNull() | (F.col("message_index").cast("string") == ""), 0).otherwise(F.coalesce(F.col("message_index").try_cast("int"), F.lit(-1)))
    usable = (F.length("__quote") >= min_chars) & (F.col("__norm") != "")
    here = F.coalesce((index >= 0) & F.contains(F.get("__texts", index), F.col("__norm")), F.lit(False))
    anywhere = F.coalesce(F.contains(F.array_join("__texts", ""), F.col("__norm")), F.lit(False))
    kept = F.when(usable & here, index).when(usable & anywhere, 0)
    out = quotes.join(blocks, keys, "left").withColumn("kept_index", kept.cast("int"))
    return out.withColumn("status", F.when(F.col("kept_index").isNotNull(), "kept").otherwise("dropped")).withColumn("quote", F.col("__quote")).drop("__quote", "__norm", "__texts")


def verify_in_blocks(evidence: DataFrame, pieces: DataFrame, keys: list[str], compose: bool = True, min_chars: int = 4) -> DataFrame:
    """``evidence`` (keys, quote) with ``kept``: whether a quote of at least ``min_chars`` is in its block.

    A novel's quotes name no place, so all that counts is the block as a whole: its ``pieces`` (keys, idx, content)
    one after the other without separator.
    """
    at = F.struct(F.col("idx").cast("int").alias("idx"), normalize("content", compose).alias("t"))
    blocks = pieces.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(at)), lambda m: m["t"]), "").alias("__text"))  # a block's size bounds it
    quotes = evidence.withColumn("quote", strip_u("quote")).withColumn("__norm", normalize("quote", compose))
    hit = (F.length("quote") >= min_chars) & (F.col("__norm") != "") & F.contains("__text", F.col("__norm"))
    return quotes.join(blocks, keys, "left").withColumn("kept", F.coalesce(hit, F.lit(False))).drop("__norm", "__text")


def find_quotes(texts: DataFrame, quotes: DataFrame, text_key: str, quote_key: str, compose: bool = True, limit: int = QUOTE_CHARS) -> DataFrame:
    """(text_key, quote_key) of each normalised quote contained in each normalised text.

    Each text is read once a set of quotes (``Needles``). Sets are bounded by ``limit``;
    more quotes make further passes, not larger broadcasts.
    """
    texts = texts.select(col(text_key).alias("at"), normalize("text", compose).alias("t"))
    quotes = quotes.select(col(quote_key).alias("b"), normalize("text", compose).alias("q")).filter("q <> ''")
    return contained(texts, quotes, limit).withColumnsRenamed({"a": text_key, "b": quote_key})


def contained(texts: DataFrame, quotes: DataFrame, limit: int = QUOTE_CHARS) -> DataFrame:
    """(a, b): for each text (at, t) the keys of the quotes (b, q) that it contains, as they are."""
    kinds = to_arrow_schema(texts.select(F.col("at").alias("a")).schema.add(quotes.schema["b"]))
    spark, out, rows, size = texts.sparkSession, None, [], 0

    def one(rows):
        sent = spark.sparkContext.broadcast(rows)

        def run(batches):
            needles = Needles(sent.value)
            for b in (part for whole in batches for part in parts(whole, "t")):
                hits = needles.find(b.column("t").to_pylist())
                yield pa.RecordBatch.from_arrays([b.column("at").take(pa.array([i for i, _ in hits], pa.int64())), pa.array([k for _, k in hits], kinds.field("b").type)], names=["a", "b"])

        return texts.mapInArrow(run, texts.select(F.col("at").alias("a")).schema.add(quotes.schema["b"]))

    for r in quotes.toLocalIterator():
        if rows and size + len(r["q"]) > limit:
            out = one(rows) if out is None else out.unionByName(one(rows))
            rows, size = [], 0
        rows.append((r["b"], r["q"]))
        size += len(r["q"])
    if rows or out is None:
        out = one(rows) if out is None else out.unionByName(one(rows))
    return out
