"""WARC archives: writing, normalising a monolithic gzip stream, reading by index.

``write_archives`` writes one record a page as whole-file gzip streams (Spark's
own text writer, so it works wherever Spark writes). ``normalise`` inflates each
stream once, rewrites every record as its own gzip member and writes a sidecar
index (offset, length, record id) beside the archive. ``read_archives`` fetches
each member by its index entry. Files are written under a temporary name and then
renamed, so a repeated task leaves one whole file.

Equal payloads of at least ``min_bytes`` bytes: the smallest page_id is the
response and the others revisit it. The table of repeated payloads is written
first, so that Spark broadcasts it only if its measured size is under the
session's threshold and joins by shuffle otherwise.

Edge cases: a null html is an empty payload; a null url leaves the target out; a
null page_id revisits a known one and is a response otherwise; rows that repeat a
page_id with the same payload are each a record of the same type; record ids name the
page and its payload, so only such rows share one; an empty table makes no archive and
no row; columns other than page_id, url and html are not read, whatever their names.
Archives are streamed, both ways: a task holds one record at a time, never an archive,
so a record must fit in memory and an archive of any size need not.
"""

from __future__ import annotations

import base64
import hashlib
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .work import Workspace

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS_PER_ARCHIVE = 20_000
LEVEL = 6
#: Index entries that one reading task takes at a time.
ENTRIES = 2_000


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in upper-case base32: each five hex digits are four base32 digits."""
    digest = F.sha1(payload)
    parts = []
    for g in range(8):
        n = F.conv(F.substring(digest, 5 * g + 1, 5), 16, 10).cast("int")
        parts += [F.substring(F.lit(BASE32), F.shiftright(n, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*parts)


def records(ws: Workspace, pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """One WARC record (value) per row of ``pages`` (page_id, url, html)."""
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("payload"), F.octet_length(payload).cast("long").alias("size"), F.unhex(F.sha1(payload.cast("binary"))).alias("sha"))
    same = rows.filter(F.col("size") >= min_bytes).groupBy("sha", "size").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 AND first IS NOT NULL").drop("n")
    same = ws.write(same, "repeated")
    rows = rows.join(same, ["sha", "size"], "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    uri = lambda c: F.concat(F.lit("<urn:x-page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(":"), F.lower(F.hex("sha")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(again, http).otherwise(F.concat(http, F.col("payload")))
    line = lambda name, c: F.concat(F.lit(name + ": "), c, F.lit("\r\n"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        line("WARC-Record-ID", uri(F.col("page_id"))),
        line("WARC-Date", F.lit(DATE)),
        F.coalesce(line("WARC-Target-URI", F.regexp_replace("url", r"\s", "%20")), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_sha1(F.col("payload").cast("binary")))),
        F.when(again, F.concat(line("WARC-Refers-To", uri(F.col("first"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(""),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
    )
    return rows.select(F.concat(head, block, F.lit("\r\n")).alias("value"))  # the writer's line end closes the record


def write_archives(ws: Workspace, pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Whole-file gzip streams of records under ``path``."""
    records(ws, pages, min_bytes).write.option("compression", "gzip").option("lineSep", "\r\n").option("maxRecordsPerFile", RECORDS_PER_ARCHIVE).mode("overwrite").text(path)


def inflated(read, step: int = 1 << 18):
    """The inflated bytes of a gzip file of one or more members, in parts; ``read(n)`` gives its next bytes."""
    d, data = zlib.decompressobj(31), read(step)
    while data:
        out = d.decompress(data, step * 4)
        if out:
            yield out
        if d.eof:
            data = d.unused_data or read(step)
            d = zlib.decompressobj(31)
        else:
            data = d.unconsumed_tail or read(step)
    if rest := d.flush():
        yield rest


def split_records(parts):
    """(header bytes, block bytes) of each record of a stream, holding one record at a time."""
    have = bytearray()
    parts = iter(parts)

    def fill(n: int) -> bool:
        while len(have) < n:
            more = next(parts, None)
            if more is None:
                return False
            have.extend(more)
        return True

    while fill(1):
        seen = 0
        while (end := have.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(have)
            if not fill(seen + 1):
                raise ValueError("a record's header does not end")
        head = bytes(have[: end + 4])
        size = int(header(head, b"content-length"))
        if not fill(end + 4 + size + 4):
            raise ValueError("a record is cut short")
        yield head, bytes(have[end + 4 : end + 4 + size])
        del have[: end + 4 + size + 4]


def header(head: bytes, name: bytes) -> str | None:
    for row in head.split(b"\r\n"):
        key, _, value = row.partition(b":")
        if key.strip().lower() == name:
            return value.strip().decode("utf-8", "replace")
    return None


def _open(base: str):
    if base.startswith("file:/") and not base.startswith("file://"):  # as Spark names local files
        base = "file://" + base[len("file:") :]
    where, path = fs.FileSystem.from_uri(base)
    return where, path.rstrip("/")


def _put(where, path: str, name: str, write) -> None:
    """Write under a temporary name of this attempt, then rename."""
    import uuid

    temp = f"{path}/.{name}.{uuid.uuid4().hex}"
    with where.open_output_stream(temp, compression=None) as out:
        write(out)
    where.move(temp, f"{path}/{name}")


def normalise(spark: SparkSession, source: str, base: str) -> DataFrame:
    """Rewrites each archive under ``source`` to ``base``; rows (archive, entries) of what it wrote."""

    def run(batches):
        where, path = _open(base)
        where.create_dir(path, recursive=True)
        for b in batches:
            for archive in b.column("path").to_pylist():
                there, file = _open(archive)
                name = file.rsplit("/", 1)[1].split(".")[0] + ".warc.gz"
                index: list[str] = []

                def members(out, there=there, file=file, index=index):
                    with there.open_input_stream(file, compression=None) as whole:
                        write_members(out, inflated(whole.read), index)

                def write_members(out, parts, index):
                    at = 0
                    for head, block in split_records(parts):
                        c = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                        size = sum(out.write(x) or len(x) for x in (c.compress(head), c.compress(block), c.compress(b"\r\n\r\n"), c.flush()))
                        index.append(f"{at}\t{size}\t{header(head, b'warc-record-id')}\n")
                        at += size

                _put(where, path, name, members)
                _put(where, path, name + ".idx", lambda out, index=index: out.write("".join(index).encode()))
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(index)], pa.int64())], names=["archive", "entries"])

    # an archive is inflated once, by one task; its content is streamed there, only names are dealt
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(source).select("path")
    return files.repartition(max(1, spark.sparkContext.defaultParallelism), "path").mapInArrow(run, "archive string, entries long")


def parse(member: bytes) -> tuple[int | None, int, str, str, int | None]:
    """page_id, payload bytes, digest, type and refers_to of one gzip member; a response's payload is checked."""
    raw = zlib.decompress(member, 31)
    (head, block), *rest = split_records([raw])
    if rest:
        raise ValueError("a member holds more than one record")
    kind, digest = header(head, b"warc-type"), header(head, b"warc-payload-digest").removeprefix("sha1:")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(header(http, b"content-length"))
    if kind == "response":
        if len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError(f"{header(head, b'warc-record-id')}: the payload does not match its digest")
    number = lambda s: int(n) if s and (n := s[len("<urn:x-page:") :].split(":")[0]) else None
    return number(header(head, b"warc-record-id")), size, digest, kind, number(header(head, b"warc-refers-to"))


def read_archives(archives: DataFrame, base: str) -> DataFrame:
    """Every record of ``archives`` (archive, entries), each member fetched by its index entry."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def run(batches):
        where, path = _open(base)
        for b in batches:
            for name, first in zip(b.column("archive").to_pylist(), b.column("first").to_pylist(), strict=True):
                with where.open_input_stream(f"{path}/{name}.idx", compression=None) as f:
                    index = [r.split("\t") for r in f.read().decode().splitlines()[first : first + ENTRIES]]
                with where.open_input_file(f"{path}/{name}") as f:
                    rows = [parse(f.read_at(int(size), int(at))) for at, size, _ in index]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    parts = archives.filter("entries > 0").select("archive", F.explode(F.sequence(F.lit(0), F.col("entries") - 1, F.lit(ENTRIES))).alias("first"))
    return parts.repartition(max(1, parts.sparkSession.sparkContext.defaultParallelism), "archive", "first").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record that ``pages`` make, read back from the archives."""
    ws = Workspace(spark, "warc")
    whole, base = f"{ws.path}/whole", f"{ws.path}/archives"
    write_archives(ws, spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), whole)
    archives = ws.write(normalise(spark, whole, base), "archives-list")
    ws.drop(whole)
    return read_archives(archives, base)


OP3_SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS t FROM pages
), d AS (
  SELECT page_id, CAST(strlen(t) AS BIGINT) AS payload_bytes, sha1(t) AS h FROM p
), o AS (
  SELECT *, min(page_id) OVER (PARTITION BY h) AS f FROM d
)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((CAST('0x' || substr(h, CAST(i // 4 * 5 + 1 AS BIGINT), 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) + 1, 1)), '') AS payload_digest,
  CASE WHEN f IS NULL OR page_id IS NOT DISTINCT FROM f THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN f IS NULL OR page_id IS NOT DISTINCT FROM f THEN NULL ELSE f END AS refers_to
FROM o
"""
