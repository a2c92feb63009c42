"""Files to messages: Telegram JSON, generic JSONL and CSV, MemoTrace JSON; TXT and EPUB novels.

All readers go through Spark's own file sources, so any file system Spark reads
will do. A JSON export is one document and is read whole by one task per file; lines of
JSONL are read block by block, whatever a file's size, and numbered all the same.
"""

from __future__ import annotations

import io
import posixpath
import zipfile
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import clean_text, col, entity_text, first_truthy, is_blank, strip_u

CHAT_EXTENSIONS = (".csv", ".json", ".jsonl")
NOVEL_EXTENSIONS = (".epub", ".txt")
SOURCES = ("telegram", "generic_jsonl", "generic_csv", "memotrace", "auto")
HEAD_CHARS = 2000


class ImportFailed(ValueError):
    """The file's format is unknown, lacks a needed column or holds no message."""


def extension(path: str) -> str:
    return posixpath.splitext(path.rsplit("/", 1)[-1])[1].lower()


def sniff_format(path: str) -> str:
    """"chat" or "novel" by extension; ValueError for others."""
    ext = extension(path)
    if ext in CHAT_EXTENSIONS:
        return "chat"
    if ext in NOVEL_EXTENSIONS:
        return "novel"
    what = f"extension {ext}" if ext else "no extension"
    raise ValueError(f"{path}: {what}; chats are {', '.join(CHAT_EXTENSIONS)} and novels {', '.join(NOVEL_EXTENSIONS)}")


def sniff_column(path) -> Column:
    """As ``sniff_format`` for a column of paths; null where not supported."""
    ext = F.lower(F.regexp_extract(col(path), r"[^/](\.[^./]*)$", 1))
    return F.when(ext.isin(*CHAT_EXTENSIONS), "chat").when(ext.isin(*NOVEL_EXTENSIONS), "novel")


def direction(sender, self_names) -> Column:
    names = sorted(self_names or ())
    return F.when(strip_u(sender).isin(*names) if names else F.lit(False), "self").otherwise("other")


def _whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True)


def _counted(df: DataFrame, group: list[str], weight: str | None = None) -> DataFrame:
    """``df`` with ``__before``, the number of rows (or the sum of ``weight``) before each one of those of equal ``group`` that the scan reads in a row."""
    out = T.StructType([*df.schema.fields, T.StructField("__before", T.LongType())])

    def run(batches):
        at, count = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            size = np.asarray(b.column(weight), dtype=np.int64) if weight else np.ones(b.num_rows, dtype=np.int64)
            keys = list(zip(*(b.column(c).to_pylist() for c in group), strict=True))
            new = np.array([i == 0 or keys[i] != keys[i - 1] for i in range(b.num_rows)])
            new[0] = keys[0] != at
            before = np.cumsum(size) - size + count
            start = np.maximum.accumulate(np.where(new, np.arange(b.num_rows), -1))
            before = np.where(start >= 0, before - before[start.clip(min=0)], before)
            at, count = keys[-1], int(before[-1] + size[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(before)], names=[*b.schema.names, "__before"])

    return df.mapInArrow(run, out)


#: Ends of lines as Python's str.splitlines sees them, but for those at which Spark ends lines itself.
MORE_ENDS = r"[\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, n, line) of every line, numbered from 1 in its file; one more, blank, where a file ends in one of ``MORE_ENDS``.

    Files are read in blocks by as many tasks: lines are counted within their block as they are read, and
    blocks begin where the lines of those before them end, by a prefix sum of one row a block.
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"), F.split("value", MORE_ENDS, -1).alias("parts")).withColumn("size", F.size("parts"))
    each = _counted(raw, ["path", "at"], "size")
    block = _counted(raw.select("path", "at", "size"), ["path", "at"], "size").groupBy("path", "at").agg(F.max(F.col("__before") + F.col("size")).alias("lines"))
    earlier = W.partitionBy("path").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    block = block.select("path", "at", F.coalesce(F.sum("lines").over(earlier), F.lit(0)).alias("start"))
    rows = each.join(block, ["path", "at"]).select("path", (F.col("start") + F.col("__before")).alias("start"), F.posexplode("parts").alias("i", "line"))
    return rows.select("path", (F.col("start") + F.col("i") + 1).alias("n"), "line")


def _messages(rows: DataFrame, **cols) -> DataFrame:
    out = rows.select(*(cols[c].alias(c) for c in ("ord", "ts", "sender_id", "sender_name", "direction", "content", "type", "source")))
    return out.filter(~is_blank("content"))


def _text(v: str, name: str) -> Column:
    """A member as text; a false value of any kind reads as null."""
    s = F.try_variant_get(v, f"$.{name}", "string")
    kind = F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant"))
    false = (s == "") | ((kind != "STRING") & s.isin("0", "0.0", "false", "[]", "{}"))
    return F.when(~false, s)


def read_telegram(spark: SparkSession, path: str, self_names=()) -> DataFrame:
    doc = _whole(spark, path).select(F.try_parse_json("value").alias("d")).select(F.try_variant_get("d", "$.messages", "array<variant>").alias("m"))
    rows = doc.select(F.posexplode("m").alias("i", "v")).filter(F.try_variant_get("v", "$.type", "string") == "message")
    sender = F.coalesce(_text("v", "from"), _text("v", "actor"), F.lit("unknown"))
    rows = rows.select("i", "v", sender.alias("sender"))
    return _messages(
        rows, ord=F.col("i").cast("bigint"), ts=F.coalesce(_text("v", "date_unixtime"), _text("v", "date"), F.col("i").cast("string")), sender_id=F.coalesce(_text("v", "from_id"), "sender"), sender_name=F.col("sender"),
        direction=direction("sender", self_names), content=entity_text(F.try_variant_get("v", "$.text", "variant")), type=F.lit("text"), source=F.lit("telegram"),
    )


def read_jsonl(spark: SparkSession, path: str, self_names=()) -> DataFrame:
    """Bad lines and lines that are no object are skipped; the physical line number stands in for ts."""
    rows = numbered_lines(spark, path).select("n", F.try_parse_json(strip_u("line")).alias("v")).filter(F.schema_of_variant("v").startswith("OBJECT"))
    sender = F.coalesce(_text("v", "sender_name"), _text("v", "sender"), F.lit("unknown"))
    rows = rows.select("n", "v", sender.alias("sender"))
    told = F.try_variant_get("v", "$.direction", "string")
    return _messages(
        rows, ord=F.col("n"), ts=F.coalesce(_text("v", "ts"), F.col("n").cast("string")), sender_id=F.coalesce(_text("v", "sender_id"), "sender"), sender_name=F.col("sender"), direction=F.when(told.isin("self", "other"), told).otherwise(direction("sender", self_names)),
        content=F.coalesce(_text("v", "content"), F.lit("")), type=F.coalesce(_text("v", "type"), F.lit("text")), source=F.coalesce(_text("v", "source"), F.lit("generic")),
    )


def read_csv(spark: SparkSession, path: str, self_names=()) -> DataFrame:
    """Needs the columns sender and content; the number of the record in its file stands in for ts."""
    raw = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
    if not {"sender", "content"} <= set(raw.columns):
        raise ImportFailed(f"{path}: sender and content are needed, the columns are {sorted(raw.columns)}")
    wanted = [c for c in ("sender", "content", "ts", "type") if c in raw.columns]
    # records that are quoted over lines cannot be found from within a file, so one task reads a file in order, and may read several
    rows = _counted(raw.select(*wanted, F.col("_metadata.file_path").alias("__path")), ["__path"]).withColumn("n", F.col("__before") + 1)
    other = lambda c, d: first_truthy(F.col(c), d) if c in raw.columns else d
    sender = other("sender", F.lit("unknown"))
    return _messages(
        rows, ord=F.col("n"), ts=other("ts", F.col("n").cast("string")), sender_id=sender, sender_name=sender, direction=direction(sender, self_names),
        content=F.coalesce("content", F.lit("")), type=other("type", F.lit("text")), source=F.lit("generic"),
    )


def read_memotrace(spark: SparkSession, path: str, self_names=()) -> DataFrame:
    """An array, or an object's messages or data; is_sender goes before names."""
    doc = _whole(spark, path).select(F.try_parse_json("value").alias("d"))
    part = lambda p: F.try_variant_get("d", p, "array<variant>")
    some = lambda c: F.when(F.size(c) > 0, c)
    kind = F.schema_of_variant("d")
    listed = F.when(kind.startswith("ARRAY"), part("$")).otherwise(F.coalesce(some(part("$.messages")), some(part("$.data"))))
    odd = F.schema_of_variant(F.coalesce(F.try_variant_get("d", "$.messages", "variant"), F.try_variant_get("d", "$.data", "variant")))
    bad = doc.select(kind.alias("k"), odd.alias("o")).filter(F.col("k").isNull() | ~(F.col("k").startswith("ARRAY") | F.col("k").startswith("OBJECT")) | (F.col("k").startswith("OBJECT") & ~F.coalesce(F.col("o").startswith("ARRAY") | (F.col("o") == "VOID"), F.lit(True))))
    if not bad.isEmpty():
        raise ImportFailed(f"{path}: an array, or one under messages or data, is needed")
    rows = doc.select(F.posexplode(listed).alias("i", "v")).filter(F.schema_of_variant("v").startswith("OBJECT"))
    sender = F.coalesce(_text("v", "sender"), _text("v", "talker"), _text("v", "sender_name"), F.lit("unknown"))
    flag = F.try_variant_get("v", "$.is_sender", "string")
    has = F.try_variant_get("v", "$.is_sender", "variant").isNotNull()
    kind = F.coalesce(_text("v", "type"), F.lit("text"))
    rows = rows.select("i", "v", sender.alias("sender"))
    return _messages(
        rows, ord=F.col("i").cast("bigint"), ts=F.coalesce(_text("v", "ts"), _text("v", "timestamp"), _text("v", "create_time"), _text("v", "StrTime"), F.col("i").cast("string")), sender_id=F.col("sender"), sender_name=F.col("sender"),
        direction=F.when(has, F.when(flag.isin("1", "true", "True"), "self").otherwise("other")).otherwise(direction("sender", self_names)),
        content=F.coalesce(_text("v", "content"), _text("v", "message"), _text("v", "msg"), F.lit("")), type=F.when(kind == "1", "text").when(kind.rlike("^[0-9]+$"), "media").otherwise(kind), source=F.lit("memotrace"),
    )


READERS = {"telegram": read_telegram, "generic_jsonl": read_jsonl, "generic_csv": read_csv, "memotrace": read_memotrace}


def sniff_source(spark: SparkSession, path: str) -> str:
    """The reader for a file: by extension, and for .json by the members its head names."""
    ext = extension(path)
    if ext in (".jsonl", ".csv"):
        return {".jsonl": "generic_jsonl", ".csv": "generic_csv"}[ext]
    if ext != ".json":
        raise ImportFailed(f"{path}: cannot tell the format by its extension; name one of {SOURCES}")
    head = _whole(spark, path).select(F.substring("value", 1, HEAD_CHARS)).first()[0]
    return "telegram" if '"messages"' in head and ('"type"' in head or '"from_id"' in head) else "memotrace"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def import_file(spark: SparkSession, path: str, source: str = "auto", self_names=()) -> DataFrame:
    """Messages of one file; raises FileNotFoundError, or ImportFailed for an unknown format or no messages."""
    if not _exists(spark, path):
        raise FileNotFoundError(path)
    source = sniff_source(spark, path) if source == "auto" else source
    if source not in READERS:
        raise ImportFailed(f"unknown source {source!r}; there are {SOURCES}")
    out = READERS[source](spark, path, self_names)
    if out.isEmpty():
        raise ImportFailed(f"{path}: no message as {source}; check the format and the names of the self side")
    return out


def relabel(messages: DataFrame, target: str) -> DataFrame:
    """Direction anew, once the person to describe has been chosen."""
    return messages.withColumn("direction", F.when(F.col("sender_name") == target, "self").otherwise("other"))


SAMPLES, SAMPLE_CHARS = 3, 60


def sender_stats(messages: DataFrame, sender="sender_name", content="content", order=("ord",)) -> DataFrame:
    """Per sender: count and the first three samples of at least two characters, most frequent first, ties by first appearance.

    Row numbers up to three are cut off before the shuffle, so a frequent sender is no heavy group.
    """
    place = F.struct(*order)
    rows = messages.select(col(sender).alias("name"), strip_u(content).alias("s"), place.alias("at"))
    counts = rows.groupBy("name").agg(F.count("*").alias("count"), F.min("at").alias("first"))
    few = rows.filter(F.length("s") >= 2).withColumn("n", F.row_number().over(W.partitionBy("name").orderBy("at"))).filter(F.col("n") <= SAMPLES)
    samples = few.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", F.substring("s", 1, SAMPLE_CHARS).alias("s")))), lambda x: x["s"]).alias("samples"))
    out = counts.join(samples, "name", "left").withColumn("samples", F.coalesce("samples", F.array().cast("array<string>")))
    return out.orderBy(F.desc("count"), "first").select("name", "count", "samples")


def inspect_file(spark: SparkSession, path: str) -> dict:
    """Format, total and senders of a chat file, before a person is chosen."""
    if extension(path) not in CHAT_EXTENSIONS:
        sniff_format(path)
        raise ValueError(f"{path}: a novel has no senders; chats are {', '.join(CHAT_EXTENSIONS)}")
    messages = READERS[sniff_source(spark, path)](spark, path)
    senders = [r.asDict() for r in sender_stats(messages).collect()]  # one row a sender
    return {"format": extension(path), "total": sum(s["count"] for s in senders), "senders": senders}


#: The elements whose leading text counts.
TEXT_TAGS = ("p", "h1", "h2", "h3", "div", "title")


def epub_text(data: bytes, natural: bool = False) -> str:
    """Leading text of the text elements of a book's pages, by member name; pages that do not parse are skipped."""
    import re

    parts = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = [n for n in z.namelist() if n.endswith((".xhtml", ".html", ".htm"))]
        key = (lambda n: [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", n)]) if natural else None
        for name in sorted(names, key=key):
            try:
                root = ElementTree.fromstring(z.read(name))
            except ElementTree.ParseError:
                continue
            parts += [e.text.strip() for e in root.iter() if isinstance(e.tag, str) and e.tag.rpartition("}")[2] in TEXT_TAGS and e.text]
    return "\n".join(parts)


def read_novels(spark: SparkSession, path: str, natural: bool = False) -> DataFrame:
    """(path, text) of each .txt (undecodable bytes dropped) and .epub under ``path``, cleaned."""

    def run(batches):
        for b in batches:
            texts = []
            for p, c in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                ext = extension(p)
                if ext not in NOVEL_EXTENSIONS:
                    raise ValueError(f"{p}: novels are {', '.join(NOVEL_EXTENSIONS)}")
                texts.append(epub_text(c, natural) if ext == ".epub" else c.decode("utf-8", "ignore"))
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(texts, pa.string())], names=["path", "text"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, text string").withColumn("text", clean_text("text"))


#: The same elements in HTML that is no XML: opening tags and the text up to the next tag.
HTML_TEXT = r"(?is)<(?:p|h1|h2|h3|div|title)(?:\s[^>]*)?>([^<]+)"


def html_text(html) -> Column:
    """Leading text of the text elements of a page, cleaned; entities as they are."""
    return clean_text(F.array_join(F.transform(F.regexp_extract_all(F.coalesce(col(html), F.lit("")), F.lit(HTML_TEXT), 1), strip_u), "\n"))
