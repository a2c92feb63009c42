"""Order MinHash fingerprints of texts: likeness that falls with edit distance.

The items of a text are its k-mers (``K`` code points), each with its occurrence number,
so that repeats count; they are hashed together. A component of the fingerprint is made
from the ``TUPLE`` items of the smallest hashes, put back in their order in the text and
hashed as a tuple of k-mers: moving passages about changes it, unlike a set's minimum.

Hash functions. ``SEEDS`` independent functions are each used from ``POINTS`` places: the
j-th order is that of (hash - j / POINTS) around the circle of 48-bit numbers. So one sort
a seed serves ``POINTS`` components, at any length of text, and each is the minimum of a
random order. Of long texts only items near these places are sorted; where these do not
suffice for a place, all items of that text are.

``likeness`` of two fingerprints is the share of equal components (16 bits each, so that
components of unlike tuples are equal once in 65,536 times).

Edge cases: a null text is an empty one; a text of fewer than ``K`` code points is one
item, a text with fewer than ``TUPLE`` items makes tuples of those it has, and all
components of an empty text are 0; equal texts have equal fingerprints wherever they
stand; bytes that are no UTF-8 count as replacement characters; an empty table gives no
rows; whole texts count, a very long one being a slice of its own; columns of other names
are handed through (``fingerprints``) or not read (``edited``).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import GOLDEN, Texts, U, mix, pieces, rolling
from .work import small_batches, through

K, TUPLE, SEEDS, POINTS = 8, 2, 2, 64
SLICE = 1 << 18  # bytes of text at a time
NEAR = 8  # items near a place, in tuples, that are looked at first


class Points:
    """Texts as code points: ``of[first[i]:first[i + 1]]`` are those of text i, ``lead`` the place of each one's first byte."""

    def __init__(self, t: Texts):
        self.offs, raw = t.offs, t.buf.tobytes()
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            fixed = [t.raw(i).decode("utf-8", "replace").encode() for i in range(t.n)]
            raw = b"".join(fixed)
            text, self.offs = raw.decode(), np.cumsum([0, *map(len, fixed)])
        self.raw = raw
        self.of = np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype(np.uint64)
        starts = (np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80
        self.lead = np.append(np.flatnonzero(starts), len(raw))
        self.first = np.searchsorted(self.lead[:-1], self.offs)

    def cut(self, i: int, n: int) -> bytes:
        """The first n code points of text i."""
        return self.raw[self.offs[i] : self.lead[self.first[i] + n]]


def _occurrences(h: np.ndarray, text: np.ndarray) -> np.ndarray:
    """How often each item's hash stands before it in its text."""
    out = np.zeros(len(h), dtype=np.uint64)
    bits = U(len(h).bit_length())
    # hashes and places in one word: a fast sort that finds all that can be repeated
    key = np.sort((mix(h + mix(text.astype(np.uint64))) & ~((U(1) << bits) - U(1))) | np.arange(len(h), dtype=np.uint64))
    same = key[1:] >> bits == key[:-1] >> bits
    some = np.zeros(len(h), dtype=bool)
    some[:-1] |= same
    some[1:] |= same
    at = np.sort((key[some] & ((U(1) << bits) - U(1))).astype(np.int64))
    order = at[np.lexsort((at, h[at], text[at]))]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (text[order][1:] != text[order][:-1])
    place = np.arange(len(order))
    out[order] = place - np.maximum.accumulate(np.where(new, place, 0))
    return out


def _smallest(ring: np.ndarray, text: np.ndarray, n: np.ndarray, tuple_: int, points: int, near: int) -> np.ndarray:
    """Places of the ``tuple_`` items that follow each of the points, (texts, points, tuple_); -1 where a text has fewer.

    ``ring`` has the items' 48-bit places on the circle; equal ones are in order of the text.
    """
    texts, arc = len(n), (1 << 48) // points
    out = np.full((texts, points, tuple_), -1, dtype=np.int64)
    todo = np.flatnonzero(n)
    share = near * tuple_ * points / np.maximum(n, 1)
    for whole in (False, True):
        part = ~(share >= 1) & (not whole)
        edge = np.where(part, share * arc, arc).astype(np.uint64)
        live = np.zeros(texts, dtype=bool)
        live[todo] = True
        at = np.flatnonzero(((ring & U(arc - 1)) < np.where(live, edge, U(0))[text]))
        key = text[at].astype(np.uint64) << U(48) | ring[at]
        order = np.argsort(key)
        if (key[order][1:] == key[order][:-1]).any():
            order = np.argsort(key, kind="stable")
        at, key = at[order], key[order]
        arcs = np.bincount((key // U(arc)).astype(np.int64), minlength=texts * points).reshape(texts, points)[todo]
        have = arcs.sum(axis=1)
        begin = np.searchsorted(text[at], todo)
        nth = (np.cumsum(arcs, axis=1) - arcs)[:, :, None] + np.arange(tuple_)  # a text's items before each point
        fits = np.arange(tuple_) < have[:, None, None]
        if len(at):
            found = at[(begin[:, None, None] + nth % np.maximum(have, 1)[:, None, None]).clip(max=len(at) - 1)]
            # what was left out does not matter where every point's own arc has enough
            good = ~part[todo] | (arcs >= tuple_).all(axis=1)
            out[todo[good]] = np.where(fits, found, -1)[good]
            todo = todo[~good]
        if not len(todo):
            break
    return out


def sketch(codes: np.ndarray, first: np.ndarray, k: int = K, tuple_: int = TUPLE, seeds: int = SEEDS, points: int = POINTS, near: int = NEAR) -> np.ndarray:
    """Fingerprints, a row of 16-bit components each, of texts whose code points are codes[first[i]:first[i + 1]]. ``points`` is a power of two."""
    size = np.diff(first)
    texts = len(size)
    n = np.where(size >= k, size - k + 1, np.minimum(size, 1))
    text = np.repeat(np.arange(texts), n)
    begin = np.cumsum(n) - n
    at = np.arange(int(n.sum())) - np.repeat(begin, n) + np.repeat(first[:-1], n)
    grams = rolling(mix(codes + U(1)), k)
    h = grams[at.clip(max=max(0, len(grams) - 1))] if len(grams) else np.zeros(len(at), dtype=np.uint64)
    for i in np.flatnonzero((size > 0) & (size < k)).tolist():
        h[begin[i]] = int.from_bytes(hashlib.blake2b(codes[first[i] : first[i + 1]].tobytes(), digest_size=8).digest(), "little")
    item = mix(h + _occurrences(h, text) * U(0xD6E8FEB86659FD93))
    out = np.zeros((texts, seeds * points), dtype=np.uint16)
    for seed in range(seeds):
        pick = np.sort(_smallest(mix(item + U(seed * int(GOLDEN) % (1 << 64))) >> U(16), text, n, tuple_, points, near), axis=2)  # in order of the text
        value = np.full(pick.shape[:2], U(seed + 1))
        for j in range(tuple_):
            has = pick[:, :, j] >= 0
            value = np.where(has, mix(value * GOLDEN ^ np.where(has, h[pick[:, :, j].clip(min=0)] if len(h) else U(0), U(0))), value)
        out[:, seed * points : (seed + 1) * points] = (value >> U(48)).astype(np.uint16)
    out[n == 0] = 0
    return out


def _hex(rows: np.ndarray) -> list[str]:
    return [r.tobytes().hex() for r in rows.astype(">u2")]


def fingerprints(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint of ``text`` in hexadecimal digits, four a component; no shuffle."""
    small_batches(docs.sparkSession)

    def kernel(column):
        def run(batches):
            for whole in batches:
                for b in pieces(whole, column, SLICE):
                    p = Points(Texts(b.column(column)))
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(_hex(sketch(p.of, p.first)), pa.string())], names=[*b.schema.names, f"c{b.num_columns}"])

        return run

    return through(docs, text, kernel, T.StructField(name, T.StringType()))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal components of two fingerprints."""
    n = F.length(a) / 4
    at = F.sequence(F.lit(1), F.length(a), F.lit(4))
    return F.size(F.filter(at, lambda i: F.substring(a, i, F.lit(4)) == F.substring(b, i, F.lit(4)))) / n


#: Buckets of consecutive rows a partition of the shuffle.
SPREAD = 8


def in_order(docs: DataFrame) -> DataFrame:
    """(doc_id, text, bucket, sub, ahead): rows in buckets of consecutive rows, each with the first row of what follows.

    The order is by descending doc_id, nulls last, and rows of one id by their texts; after
    the last row comes the first. A bucket's rows are sorted in their partition and
    end with a row ``ahead`` of the next bucket. Buckets are cut at quantiles of the
    ids; an id that holds several, and the null, are split by a hash of the text.
    """
    spark = docs.sparkSession
    n = SPREAD * int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = F.percentile_approx("doc_id", F.array(*(F.lit((i + 1) / n) for i in range(n - 1))), F.lit(max(10_000, 4 * n)))
    found = np.array(docs.agg(at.alias("cuts")).first()["cuts"] or [], dtype=np.int64)  # a number a bucket
    cuts, times = np.unique(found, return_counts=True)
    heavy = cuts[times > 1]

    def bucket(ids: pa.Array) -> pa.Array:
        value = np.asarray(ids.fill_null(0))
        place = 2 * np.searchsorted(cuts, value) + 1 + np.isin(value, heavy)
        return pa.array(np.where(np.asarray(ids.is_null()), 0, place).astype(np.int32))

    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    d = d.select("doc_id", "text", F.arrow_udf(bucket, "int")("doc_id").alias("bucket"), F.xxhash64("text").alias("h"))
    split = F.when(F.col("bucket") % 2 == 0, F.shiftright("h", 58)).otherwise(0).cast("int")  # even: the null and heavy ids
    d = d.withColumn("sub", split)
    heads = d.groupBy("bucket", "sub").agg(F.min(F.struct(F.bitwise_not("doc_id").alias("i"), "h")).alias("m")).select("bucket", "sub", "m.h", F.bitwise_not("m.i").alias("doc_id"))
    heads = sorted(heads.collect(), key=lambda r: (-r["bucket"], r["sub"]))  # one a bucket
    to = [(r["doc_id"], r["h"], p["bucket"], p["sub"]) for r, p in zip(heads, [*heads[-1:], *heads[:-1]], strict=True)]
    to = F.broadcast(spark.createDataFrame(to, "i long, g long, bucket int, sub int"))
    ahead = d.drop("bucket", "sub").join(to, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("g")))
    ahead = ahead.groupBy("bucket", "sub").agg(F.min("doc_id").alias("doc_id"), F.min("text").alias("text"), F.lit(True).alias("ahead"))
    both = d.withColumn("ahead", F.lit(False)).unionByName(ahead.withColumn("h", F.lit(None).cast("long")))
    return both.repartition("bucket", "sub").sortWithinPartitions("bucket", "sub", "ahead", F.desc_nulls_last("doc_id"), "h", "text").drop("h")


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _pairs(batches):
    last = None
    for b in batches:
        table = pa.Table.from_batches([b] if last is None else [last, b])
        whole = table.combine_chunks().to_batches()[0] if table.num_rows else b
        size = np.asarray(pa.compute.binary_length(whole.column("text")), dtype=np.int64) if whole.num_rows else np.empty(0, dtype=np.int64)
        start = 0
        while start < whole.num_rows - 1:
            stop = start + 1  # some rows, and the one that follows
            while stop < whole.num_rows - 1 and size[start : stop + 1].sum() < SLICE:
                stop += 1
            yield _judge(whole.slice(start, stop + 1 - start))
            start = stop
        last = whole.slice(whole.num_rows - 1) if whole.num_rows else last


def _judge(b: pa.RecordBatch) -> pa.RecordBatch:
    """The result of every row but the last, each edited with the one after it; rows ahead of a bucket have none."""
    p = Points(Texts(b.column("text")))
    n = np.diff(p.first)
    own = sketch(p.of, p.first)
    at = np.flatnonzero(~np.asarray(b.column("ahead").slice(0, b.num_rows - 1).to_numpy(zero_copy_only=False)))
    kept, taken = n[at] - n[at] // 3, np.minimum(n[at] // 3, n[at + 1])
    begin = np.stack([p.first[at], p.first[at + 1]], axis=1).ravel()
    size = np.stack([kept, taken], axis=1).ravel()
    where = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin, size)
    edited = sketch(p.of[where], np.append(0, np.cumsum(kept + taken)))
    sha = [hashlib.sha256(p.cut(i, k) + p.cut(i + 1, m)).hexdigest() for i, k, m in zip(at.tolist(), kept.tolist(), taken.tolist(), strict=True)]
    near = lambda other: pa.array((own[at] == other).mean(axis=1))
    cols = [b.column("doc_id").take(pa.array(at)), pa.array(n[at]), pa.array(sha, pa.string()), pa.array(_hex(own[at]), pa.string()), pa.array(_hex(edited), pa.string()), near(edited), near(own[at + 1])]
    return pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in EDITED.split(", ")])


def edited(docs: DataFrame) -> DataFrame:
    """The fingerprint of each text of ``docs`` (doc_id, text), of the text with its last third replaced from the next one, and their likeness."""
    small_batches(docs.sparkSession)
    return in_order(docs).mapInArrow(_pairs, EDITED)


def op11_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents, and how near an edited text and the next document are."""
    return edited(spark.read.parquet(f"{sf_dir}/documents.parquet"))
