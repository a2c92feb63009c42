"""Messages and novels into blocks."""

from __future__ import annotations

import itertools
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.batches import parts
from ..functions.text import clean_text, col
from ..functions.timestamps import parse_ts
from ..plans.scratch import written


def chunk_messages(messages: DataFrame, keys: list[str], block_size: int = 100, gap_hours: float = 6.0, ts="ts", ord="ord", dt=None) -> DataFrame:
    """Adds block_id and idx (0-based), per value of ``keys``.

    In order of the timestamp string and then ``ord``, a block ends when it has
    ``block_size`` messages or when a message is more than ``gap_hours`` after the
    last one whose time can be read. A gap always starts the count anew, so blocks
    are runs between gaps cut into equal parts: windows over one shuffle by
    ``keys``, and no sequential pass. ``dt`` gives the time where it need not be parsed.
    """
    if block_size < 1:
        raise ValueError("block_size must be at least 1")
    order = W.partitionBy(*keys).orderBy(col(ts), col(ord))
    df = messages.withColumn("__dt", parse_ts(col(ts)) if dt is None else col(dt))
    before = F.last("__dt", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1))
    gap = F.coalesce((F.unix_micros("__dt") - F.unix_micros(before)) > int(gap_hours * 3_600_000_000), F.lit(False))
    df = df.withColumn("__gap", gap.cast("int")).withColumn("__run", F.sum("__gap").over(order.rowsBetween(W.unboundedPreceding, 0)))
    place = F.row_number().over(W.partitionBy(*keys, "__run").orderBy(col(ts), col(ord))) - 1
    df = df.withColumn("__place", place).withColumn("__part", F.floor(F.col("__place") / block_size))
    block = F.dense_rank().over(W.partitionBy(*keys).orderBy("__run", "__part")) - 1
    return df.withColumn("block_id", block.cast("int")).withColumn("idx", (F.col("__place") % block_size).cast("int")).drop("__dt", "__gap", "__run", "__place", "__part")


def chunk_hot_messages(messages: DataFrame, keys: list[str], block_size: int = 100, gap_hours: float = 6.0, ts="ts", ord="ord", dt=None, ranges: int | None = None, cut=None) -> DataFrame:
    """``chunk_messages`` where one value of ``keys`` may hold most messages, or all.

    Messages are dealt by ranges of (keys, timestamp, ord), so one conversation lies in many ranges, and all
    windows are per range. What a range must know of earlier ones is carried over by
    prefix sums of one row a range and conversation: the last time that can be read, the messages since the
    last gap, and the blocks begun. ``ranges`` is their number, by default left to adaptive execution. ``cut`` (df,
    name) fixes the ranges, and later what is known by then; by default it writes a table in the shared folder.
    """
    if block_size < 1:
        raise ValueError("block_size must be at least 1")
    cut = cut or written
    time = parse_ts(col(ts)) if dt is None else col(dt)
    df = messages.withColumn("__at", F.unix_micros(time)).withColumn("__k", F.struct(*keys) if keys else F.lit(0)).withColumn("__o", F.struct(col(ts).alias("t"), col(ord).alias("o")))
    df = cut(df.repartitionByRange(*([ranges] if ranges else []), "__k", "__o").withColumn("__range", F.spark_partition_id()), "ranges")
    here, rows = ["__k", "__range"], W.partitionBy("__k", "__range").orderBy("__o")
    earlier = W.partitionBy("__k").orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    so_far = W.partitionBy("__k").orderBy("__range").rowsBetween(W.unboundedPreceding, 0)

    # the last time before each range
    last = df.groupBy(*here).agg(F.max(F.when(F.col("__at").isNotNull(), F.struct("__o", "__at")))["__at"].alias("__last"))
    last = last.select(*here, F.last("__last", ignorenulls=True).over(earlier).alias("__before"))
    df = df.join(last, here)
    before = F.coalesce(F.last("__at", ignorenulls=True).over(rows.rowsBetween(W.unboundedPreceding, -1)), F.col("__before"))
    gap = F.coalesce(F.col("__at") - before > int(gap_hours * 3_600_000_000), F.lit(False)).cast("int")
    df = df.withColumn("__gap", gap).withColumn("__run", F.sum("__gap").over(rows.rowsBetween(W.unboundedPreceding, 0)))
    df = df.withColumn("__place", F.row_number().over(W.partitionBy(*here, "__run").orderBy("__o")) - 1)
    df = cut(df.drop("__before", "__gap"), "runs")

    # the messages since the last gap before each range: ranges with a gap start the sum anew with what follows it
    tail = df.groupBy(*here, "__run").agg(F.count("*").alias("n")).groupBy(*here).agg(F.max("__run").alias("gaps"), F.max_by("n", "__run").alias("tail"))
    tail = tail.withColumn("since", F.sum(F.when(F.col("gaps") > 0, 1).otherwise(0)).over(so_far))
    tail = tail.withColumn("open", F.sum("tail").over(W.partitionBy("__k", "since").orderBy("__range").rowsBetween(W.unboundedPreceding, 0)))
    tail = tail.select(*here, F.coalesce(F.lag("open").over(W.partitionBy("__k").orderBy("__range")), F.lit(0)).alias("__open"))
    df = df.join(tail, here).withColumn("__place", F.when(F.col("__run") == 0, F.col("__place") + F.col("__open")).otherwise(F.col("__place")))

    # the blocks begun before each range
    begins = F.when(F.col("__place") % block_size == 0, 1).otherwise(0)
    begun = df.groupBy(*here).agg(F.sum(begins).alias("n"))
    begun = begun.select(*here, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__begun"))
    df = df.join(begun, here)
    block = F.col("__begun") + F.sum(begins).over(rows.rowsBetween(W.unboundedPreceding, 0)) - 1
    df = df.withColumn("block_id", block.cast("int")).withColumn("idx", (F.col("__place") % block_size).cast("int"))
    return df.select(*messages.columns, "block_id", "idx")


def numbered(df: DataFrame, keys: list[str], order: list, name: str = "i", ranges: int | None = None, cut=None) -> DataFrame:
    """``df`` with ``name``, each row's place from 0 among those of equal ``keys`` in ``order`` (columns, ascending).

    Rows are dealt by ranges and counted within them, and one row a range carries the counts on, so the rows of one key
    are many tasks' work. ``ranges`` and ``cut`` as in ``chunk_hot_messages``.
    """
    cut = cut or written
    rows = df.withColumn("__k", F.struct(*keys) if keys else F.lit(0)).withColumn("__o", F.struct(*(col(c).alias(f"o{i}") for i, c in enumerate(order))))
    rows = cut(rows.repartitionByRange(*([ranges] if ranges else []), "__k", "__o").withColumn("__range", F.spark_partition_id()), "ranges")
    per = rows.groupBy("__k", "__range").agg(F.count("*").alias("n"))
    per = per.select("__k", "__range", F.coalesce(F.sum("n").over(W.partitionBy("__k").orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__start"))
    place = F.col("__start") + F.row_number().over(W.partitionBy("__k", "__range").orderBy("__o")) - 1
    return rows.join(per, ["__k", "__range"]).withColumn(name, place).select(*df.columns, name)


def block_bounds(chunked: DataFrame, keys: list[str], ts="ts", ord="ord") -> DataFrame:
    """One row a block: its number of messages, first and last timestamp."""
    first = F.struct(col(ts), col(ord))
    return chunked.groupBy(*keys, "block_id").agg(F.count("*").alias("n_messages"), F.min(first)[ts].alias("start_ts"), F.max(first)[ts].alias("end_ts"))


#: How an unnamed other party and the heading words read.
OTHER_PARTY = "对方"
SENTENCE_ENDS = "。！？!?…"
HEADING = r"^\s*(第[零一二三四五六七八九十百千万0-9]+[章节回卷]|Chapter\s+\d+|序章|楔子|尾声)"
PIECE_CHARS = 600
BLOCK_CHARS = 3000
FIRST_TS = 1_000_000


def render_blocks(chunked: DataFrame, keys: list[str], name=None, content="content", direction="direction") -> DataFrame:
    """One row a block: its messages as lines ``[i] who: text``, or ``[i] text`` without ``name``."""
    line = F.concat(F.lit("["), F.col("idx").cast("string"), F.lit("] "))
    if name is not None:
        line = F.concat(line, F.when(col(direction) == "self", col(name)).otherwise(F.lit(OTHER_PARTY)), F.lit(": "))
    lines = chunked.select(*keys, "block_id", F.struct("idx", F.concat(line, col(content)).alias("line")).alias("l"))
    # a block is bounded by its size, so its lines may be gathered
    return lines.groupBy(*keys, "block_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["line"]), "\n").alias("rendered"))


def split_long(text: str, limit: int = PIECE_CHARS) -> list[str]:
    """A paragraph of up to ``limit`` characters as it is, else sentences packed up to it; a longer sentence stays whole."""
    if len(text) <= limit:
        return [text]
    out, start, cut = [], 0, 0
    for m in re.finditer(f"[{SENTENCE_ENDS}]|$", text):
        if m.end() - start > limit and cut > start:
            out.append(text[start:cut])
            start = cut
        cut = m.end()
    return out + [text[start:]] * (start < len(text))


def pack(text, chunk_chars: int = BLOCK_CHARS, piece_chars: int = PIECE_CHARS):
    """(block, index in block, piece) of each piece of a cleaned text or of its lines: one pass, one block in hand."""
    block = index = size = 0
    heading = re.compile(HEADING)
    for para in text.split("\n") if isinstance(text, str) else text:
        if not para.strip():
            continue
        if index and heading.match(para):
            block, index, size = block + 1, 0, 0
        for piece in split_long(para, piece_chars):
            if index and size + len(piece) > chunk_chars:
                block, index, size = block + 1, 0, 0
            yield block, index, piece
            index, size = index + 1, size + len(piece)


def chunk_novels(books: DataFrame, key: str, text="text", chunk_chars: int = BLOCK_CHARS, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """One row a piece: ``key``, block_id, idx, ts, content.

    Packing by a running budget is sequential, so each text is packed where it is
    read, in one linear pass; there is no shuffle.
    """
    if chunk_chars < 200:
        raise ValueError("chunk_chars must be at least 200")
    books = books.select(col(key).alias("key"), clean_text(text).alias("text"))
    kind = books.schema["key"].dataType.simpleString()

    def run(batches):
        for b in (part for whole in batches for part in parts(whole, "text")):
            at, block, index, piece = [], [], [], []
            for i in range(b.num_rows):
                for x in pack(b.column("text")[i].as_py() or "", chunk_chars, piece_chars):
                    at.append(i)
                    for c, v in zip((block, index, piece), x, strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([b.column("key").take(pa.array(at, pa.int64())), pa.array(block, pa.int32()), pa.array(index, pa.int32()), pa.array(piece, pa.string())], names=["key", "block_id", "idx", "content"])

    out = books.mapInArrow(run, f"key {kind}, block_id int, idx int, content string")
    return out.select(F.col("key").alias(key), "block_id", "idx", (F.lit(FIRST_TS) + F.col("block_id")).cast("string").alias("ts"), "content")


def chunk_novel_lines(lines: DataFrame, key: str, order: str = "line", text="text", chunk_chars: int = BLOCK_CHARS, piece_chars: int = PIECE_CHARS, ranges: int | None = None, cut=None) -> DataFrame:
    """``chunk_novels`` of books that come line by line (``key``, ``order``, text), of any length.

    A heading begins a new block, so a book is cut at its headings into chapters that are
    packed each for itself, on as many tasks as there are; their blocks are numbered by a prefix sum of
    one row a chapter. Chapters are numbered within ranges of lines and these by one row a range. Only what
    stands between two headings is in order, and so one task's work, streamed line by line. Lines of no book
    are left out; a row of several lines counts as these. ``ranges`` and ``cut`` as in ``chunk_hot_messages``.
    """
    if chunk_chars < 200:
        raise ValueError("chunk_chars must be at least 200")
    cut = cut or written
    df = lines.select(col(key).alias("key"), col(order).alias("row"), F.posexplode(F.split(clean_text(text), "\n")).alias("pos", "text")).filter("key IS NOT NULL AND text <> ''")
    df = df.select("key", F.struct("row", "pos").alias("line"), "text", F.col("text").rlike(HEADING).cast("int").alias("head"))
    df = cut(df.repartitionByRange(*([ranges] if ranges else []), "key", "line").withColumn("range", F.spark_partition_id()), "lines")
    per = df.groupBy("key", "range").agg(F.sum("head").alias("n"))
    per = per.select("key", "range", F.coalesce(F.sum("n").over(W.partitionBy("key").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    here = W.partitionBy("key", "range").orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    df = df.join(per, ["key", "range"]).select("key", "line", "text", (F.col("earlier") + F.sum("head").over(here)).alias("chapter"))
    kind = df.schema["key"].dataType.simpleString()

    def run(batches):
        """One chapter after the other, each as its lines come."""

        def rows():
            for b in batches:
                yield from zip(b.column("key").to_pylist(), b.column("chapter").to_pylist(), b.column("text").to_pylist(), strict=True)

        out: list[tuple] = []
        for (book, chapter), group in itertools.groupby(rows(), key=lambda r: r[:2]):
            for block, index, piece in pack((t for *_, t in group), chunk_chars, piece_chars):
                out.append((book, chapter, block, index, piece))
                if len(out) >= 1000:
                    yield _columns(out, schema)
                    out = []
        if out:
            yield _columns(out, schema)

    out_type = f"key {kind}, chapter long, block long, idx int, content string"
    schema = to_arrow_schema(lines.sparkSession.createDataFrame([], out_type).schema)
    packed = cut(df.repartition("key", "chapter").sortWithinPartitions("key", "chapter", "line").mapInArrow(run, out_type), "chapters")
    size = packed.groupBy("key", "chapter").agg((F.max("block") + 1).alias("n"))
    start = size.select("key", "chapter", F.coalesce(F.sum("n").over(W.partitionBy("key").orderBy("chapter").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    out = packed.join(start, ["key", "chapter"]).withColumn("block_id", (F.col("start") + F.col("block")).cast("int"))
    return out.select(F.col("key").alias(key), "block_id", "idx", (F.lit(FIRST_TS) + F.col("block_id")).cast("string").alias("ts"), "content")


def _columns(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
