"""Periodic runs of words: found within each text, and collapsed to one period.

A run is a stretch of consecutive words with smallest period q (words q apart are
identical) and length at least max(``shortest``, ``times`` * q) that no neighbouring
word extends. Every text is one row's work; nothing is shuffled.

1. Masking. Within a run, words q apart agree over its length less q, which is
   ``overlap()`` words at least whatever q is. So each of its words is in a k-gram,
   k = ``overlap()``, that the text repeats; all other words are masked, and no run
   crosses one. What survives are the segments.
2. Main-Lorentz on the segments, all segments of a slice at once and level by level:
   a run lies around the middle m of a block of 2h words, h being the largest power
   of two with a multiple strictly inside the run, so its period is 2h / ``times`` at
   most and a square of that period stands right or left of m. Of all periods, those
   with such a square are extended to both sides. Sequences are compared by prefix
   sums of powers modulo a prime (extensions by binary search), and what is found is
   then compared word by word; should that fail, the search is done again with another
   base. Words are compared by 64-bit hashes.
3. A stretch found with several periods has the smallest.

Edge cases: a null or empty text has no words and no runs; null ids, repeated ids and
repeated rows are judged row by row; equal lengths are settled by start, then period; an
empty table gives an empty one; whole texts count, a very long one being a slice of its
own; columns of other names are handed through whatever they are called.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import Texts, U, Words, mix, pieces, rolling
from .work import small_batches, through

SHORTEST, TIMES = 6, 4
PRIME = (1 << 31) - 1
BASES = (1_103_515_245, 69_069, 1_664_525, 22_695_477)


def overlap(shortest: int = SHORTEST, times: int = TIMES) -> int:
    """The fewest words over which any run agrees with itself one period on."""
    return min(max(shortest, times * q) - q for q in range(1, shortest + 1))


def segments(ids: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each stretch of words in k-grams that their own text repeats."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    grams = rolling(ids, k)
    at = np.arange(len(grams))
    at = at[at + k <= first[doc[at] + 1]]
    key = mix(grams[at] + mix(doc[at].astype(np.uint64)))
    order = np.sort(key)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    at = at[twice[np.searchsorted(twice, key).clip(max=len(twice) - 1)] == key]
    depth = np.zeros(len(ids) + 1, dtype=np.int64)
    depth[at] += 1
    depth[at + k] -= 1
    on = np.cumsum(depth[:-1]) > 0
    head = on.copy()
    head[1:] &= ~on[:-1] | (doc[1:] != doc[:-1])
    tail = on.copy()
    tail[:-1] &= ~on[1:] | (doc[1:] != doc[:-1])
    return np.flatnonzero(head), np.flatnonzero(tail) + 1


class Sums:
    """Prefix sums of values times powers of a base, to compare stretches of one array."""

    def __init__(self, ids: np.ndarray, base: int):
        n = len(ids)
        power = np.ones(n + 1, dtype=np.uint64)
        have = 1
        while have <= n:  # powers by doubling
            more = min(have, n + 1 - have)
            power[have : have + more] = power[:more] * U(pow(base, have, PRIME)) % U(PRIME)
            have += more
        self.power = power
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((ids % U(PRIME) + U(1)) % U(PRIME) * power[:n] % U(PRIME), out=self.sums[1:])

    def equal(self, i: np.ndarray, far: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether ``size`` values from i on and from i + far on are the same (never no if they are)."""
        j = i + far
        one = (self.sums[i + size] - self.sums[i]) % U(PRIME) * self.power[far] % U(PRIME)
        return one == (self.sums[j + size] - self.sums[j]) % U(PRIME)

    def forward(self, i: np.ndarray, far: np.ndarray, room: np.ndarray) -> np.ndarray:
        """How far on the values from i agree with those from i + far, ``room`` at most."""
        low, high = np.zeros_like(i), room.copy()
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = self.equal(i, far, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def backward(self, i: np.ndarray, far: np.ndarray, room: np.ndarray) -> np.ndarray:
        """The same for the values before i and before i + far."""
        low, high = np.zeros_like(i), room.copy()
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = self.equal(i - mid, far, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low


def _squares(sums: Sums, starts: np.ndarray, sizes: np.ndarray, shortest: int, times: int):
    """(x, q, segment): places where a square of period q begins or ends at the middle of a block."""
    h, longest = 1, int(sizes.max(initial=0))
    while h < longest:
        most = 2 * h // times
        seg = np.flatnonzero(sizes > h)
        if most and 2 * h >= shortest:
            mids = (sizes[seg] - 1 - h) // (2 * h) + 1  # h, 3h, 5h, ... below the size
            seg = np.repeat(seg, mids)
            nth = np.arange(len(seg)) - np.repeat(np.cumsum(mids) - mids, mids)
            m = h + 2 * h * nth
            for lo in range(0, len(m), max(1, (1 << 22) // most)):  # so much of the grid at once
                part = slice(lo, lo + max(1, (1 << 22) // most))
                q = np.arange(1, most + 1)[None, :]
                mid, s = m[part, None], seg[part, None]
                for back in (0, 1):  # the square right of the middle, then the one left of it
                    fits = (mid - 2 * q >= 0) if back else (mid + 2 * q <= sizes[s])
                    r, c = np.nonzero(fits)
                    sq, ss = q[0, c], s[r, 0]
                    x = starts[ss] + mid[r, 0] - (2 * sq if back else 0)
                    hit = sums.equal(x, sq, sq)
                    yield x[hit], sq[hit], ss[hit]
        h *= 2


def main_lorentz(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray, shortest: int = SHORTEST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs inside the segments [starts, ends) of ``ids``, by start and then period."""
    sizes = ends - starts
    for base in BASES:
        sums, got = Sums(ids, base), [np.empty((0, 3), dtype=np.int64)]
        for x, q, seg in _squares(sums, starts, sizes, shortest, times):
            on = sums.forward(x, q, ends[seg] - x - q)
            back = sums.backward(x, q, x - starts[seg])
            long = back + q + on >= np.maximum(shortest, times * q)
            found = np.stack([(x - back)[long], (x + q + on)[long], q[long]], axis=1)
            got.append(_smallest(found))
        runs = _smallest(np.concatenate(got))
        start, end, q = runs.T
        # word by word: a collision could only have made a stretch too long
        size = end - start - q
        at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)
        if (ids[at] == ids[at + np.repeat(q, size)]).all():
            order = np.lexsort((q, start))
            return start[order], end[order], q[order]
    raise RuntimeError("the prefix sums of all bases collide")


def _smallest(runs: np.ndarray) -> np.ndarray:
    """One row of each (start, end): that of the smallest period."""
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    new = np.ones(len(runs), dtype=bool)
    new[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    return runs[new]


def runs_of(ids: np.ndarray, first: np.ndarray, shortest: int = SHORTEST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs of texts whose words are ids[first[i]:first[i + 1]]."""
    a, z = segments(ids, first, overlap(shortest, times))
    long = z - a >= shortest
    a, z = a[long], z[long]
    # only the words that survive are searched
    size = z - a
    begin = np.cumsum(size) - size
    at = np.arange(int(size.sum())) - np.repeat(begin, size) + np.repeat(a, size)
    start, end, q = main_lorentz(ids[at], begin, begin + size, shortest, times)
    shift = (a - begin)[np.searchsorted(begin, start, side="right") - 1] if len(start) else start
    return start + shift, end + shift, q


RUNS = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))


def periodic_runs(docs: DataFrame, text: str = "text", runs: str = "runs", collapsed: str = "collapsed", shortest: int = SHORTEST, times: int = TIMES) -> DataFrame:
    """``docs`` with all runs of ``text`` (word number, words, period) by start and period, and the text without what repeats.

    ``collapsed`` keeps, of each run, the words of the first period, joined by single spaces.
    """
    if times < 4:
        raise ValueError("times must be 4 at least")  # or no square of the period need stand at a block's middle
    small_batches(docs.sparkSession)
    listed = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))

    def kernel(name):
        def run(batches):
            for whole in batches:
                for b in pieces(whole, name):
                    t = Texts(b.column(name))
                    w = Words(t)
                    start, end, q = runs_of(w.hash, w.first, shortest, times)
                    doc = w.doc[start]
                    depth = np.zeros(len(w.hash) + 1, dtype=np.int64)
                    np.add.at(depth, start + q, 1)
                    np.subtract.at(depth, end, 1)
                    keep = np.cumsum(depth[:-1]) == 0
                    found: list = [[] for _ in range(t.n)]
                    for d, s, n, p in zip(doc.tolist(), (start - w.first[doc]).tolist(), (end - start).tolist(), q.tolist(), strict=True):
                        found[d].append({"start": s, "length": n, "period": p})
                    left = []
                    for i in range(t.n):
                        words = t.raw(i).split()
                        if found[i]:
                            words = [x for x, k in zip(words, keep[w.first[i] : w.first[i + 1]].tolist(), strict=True) if k]
                        left.append(b" ".join(words))
                    cols = [*b.columns, pa.array(found, listed), pa.array(left, pa.binary()).cast(pa.string())]
                    yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names, f"c{b.num_columns}", f"c{b.num_columns + 1}"])

        return run

    return through(docs, text, kernel, T.StructField(runs, RUNS), T.StructField(collapsed, T.StringType()))


def _looped(words: Column, crc: Column) -> Column:
    """The words of the contract's altered texts: from word a on, the p words from a again and again."""
    n, g = F.size(words), F.floor(crc / 10)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    again = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    return F.concat(F.slice(words, F.lit(1), a), F.slice(again, F.lit(1), n - a))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every whole text, every tenth of which is first looped from some word on; digests of the operator's outputs."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    crc = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda x: x != "")
    some = (crc % 10 == 0) & (F.size("words") > 0)
    docs = docs.withColumn("words", F.when(crc % 10 == 0, words))
    docs = docs.select("doc_id", F.when(some, F.array_join(_looped(F.col("words"), crc), " ")).otherwise(F.col("text")).alias("text"))
    best = F.element_at(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("q")))), 1)
    told = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    out = periodic_runs(docs).select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.when(F.size("runs") > 0, best).alias("b"), F.sha2(told, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return out.select("doc_id", "n_runs", F.col("b.s").alias("start"), (-F.col("b.l")).alias("length"), F.col("b.q").alias("period"), F.expr("(-1000 * b.l) div b.q").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def _named(levels: int) -> str:
    """CTEs that name every stretch of 1, 2, 3, 4, 6, 8, 12, ... words by where its like first stands in the text.

    A run of smallest period q has a stretch of 2q to 3q words, one of these lengths, that next occurs
    exactly q words on (an earlier one would give the run a smaller period).
    """
    out, join = [], "SELECT a.r, a.i, min(a.i) OVER (PARTITION BY a.r, a.k, b.k) AS k FROM n{} a JOIN n{} b ON a.r = b.r AND b.i = a.i + {}"
    for t in range(levels):
        out.append(f"n{2 << t} AS MATERIALIZED ({join.format(1 << t, 1 << t, 1 << t)})")
        out.append(f"n{3 << t} AS MATERIALIZED ({join.format(2 << t, 1 << t, 2 << t)})")
    return ", ".join(out)


_LEVELS = 21  # stretches of up to 3 * 2**20 words, for runs of over a million
_SQUARES = " UNION ".join(f"SELECT r, q FROM (SELECT r, lead(i) OVER (PARTITION BY r, k ORDER BY i) - i AS q FROM n{n << t}) WHERE 2 * q <= {n << t} AND {n << t} <= 3 * q" for t in range(_LEVELS) for n in (2, 3))
OP13_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda x, y: list_reduce(range(8), lambda a, b: xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END), xor(x, y)), CAST(4294967295 AS BIGINT)), 4294967295) AS h FROM documents
), g AS (
  SELECT *, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS loops, CASE WHEN len(w) > 0 THEN h // 10 % len(w) END AS a FROM d
), l AS (SELECT *, 1 + (n - a) // (3 + h // 10 % 8) AS p FROM g
), own AS MATERIALIZED (SELECT r, unnest(range(n)) AS i, unnest(w) AS x FROM l
), word AS MATERIALIZED (
  SELECT o.r, o.i, f.x FROM (SELECT own.r, own.i, CASE WHEN loops AND own.i >= a THEN a + (own.i - a) % p ELSE own.i END AS j FROM own JOIN l USING (r)) o JOIN own f ON f.r = o.r AND f.i = o.j
), n1 AS MATERIALIZED (SELECT r, i, min(i) OVER (PARTITION BY r, x) AS k FROM word
), {_named(_LEVELS)}, period AS MATERIALIZED ({_SQUARES}
), same AS (
  SELECT a.r, q, a.i, a.i - row_number() OVER (PARTITION BY a.r, q ORDER BY a.i) AS s FROM period JOIN n1 a ON a.r = period.r JOIN n1 b ON b.r = a.r AND b.i = a.i + q WHERE a.k = b.k
), run AS MATERIALIZED (
  SELECT r, s, e - s AS size, min(q) AS q FROM (SELECT r, q, min(i) AS s, max(i) + 1 + q AS e FROM same GROUP BY r, q, s HAVING count(*) + q >= greatest(6, 4 * q)) GROUP BY r, s, e
), told AS (
  SELECT r, count(*) AS n_runs, string_agg(s || ',' || size || ',' || q || chr(10), '' ORDER BY s, q) AS t, arg_min(struct_pack(s := s, size := size, q := q), struct_pack(a := -size, b := s, c := q)) AS best FROM run GROUP BY r
), gone AS (
  SELECT DISTINCT r, unnest(range(s + q, s + size)) AS i FROM run
), kept AS (
  SELECT r, string_agg(x, ' ' ORDER BY i) AS t FROM word ANTI JOIN gone USING (r, i) GROUP BY r
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.size AS length, best.q AS period, 1000 * best.size // best.q AS exponent_milli, sha256(coalesce(told.t, '')) AS runs_sha256, sha256(coalesce(kept.t, '')) AS collapsed_sha256
FROM l LEFT JOIN told ON told.r = l.r LEFT JOIN kept ON kept.r = l.r
"""
