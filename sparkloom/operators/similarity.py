"""Texts against queries by common character pairs: every pair, or the best of each query."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.text import bigrams

#: Queries go out in sets of at most this many characters a pass, pairs in batches of at most this many.
QUERY_CHARS, PAIRS = 4 << 20, 1 << 18
#: So many entries of lists, or pairs of candidates, are in memory at a time.
ENTRIES = 1 << 20


def jaccard_pairs(texts: DataFrame, queries: DataFrame, query_key: str, limit: int = QUERY_CHARS) -> DataFrame:
    """The rows of ``texts`` (keys, text) with each row of ``queries`` (query_key, text): keys, query_key, jaccard, as ``bigram_jaccard`` has it.

    Common pairs are counted over an inverted list of a set's pairs, for all its
    queries at once, in Arrow batches: an intersection for each text and query
    would walk both again. More queries make further passes, not larger broadcasts.
    """
    keys = [c for c in texts.columns if c != "text"]
    texts = texts.select(*keys, bigrams("text").alias("__grams"))
    queries = queries.select(query_key, F.coalesce(F.length("text"), F.lit(0)).alias("n"), bigrams("text").alias("g"))
    schema = texts.drop("__grams").schema.add(queries.schema[query_key]).add("jaccard", "double")
    id_type = to_arrow_type(queries.schema[query_key].dataType)
    spark, out, rows, size = texts.sparkSession, None, [], 0

    def one(rows):
        sent = spark.sparkContext.broadcast(rows)

        def run(batches):
            count = _counter([g for _, g in sent.value])
            ids = pa.array([k for k, _ in sent.value], id_type)
            n = len(ids)
            for whole in batches:
                step = max(1, PAIRS // n) if n else max(1, whole.num_rows)
                for b in (whole.slice(i, step) for i in range(0, whole.num_rows, step)):
                    at = pa.array(np.repeat(np.arange(b.num_rows), n))
                    cols = [b.column(c).take(at) for c in keys]
                    yield pa.RecordBatch.from_arrays([*cols, ids.take(pa.array(np.tile(np.arange(n), b.num_rows))), pa.array(count(b.column("__grams")).ravel())], names=[*keys, query_key, "jaccard"])

        return texts.mapInArrow(run, schema)

    for r in queries.toLocalIterator():
        if rows and size + r["n"] > limit:
            out = one(rows) if out is None else out.unionByName(one(rows))
            rows, size = [], 0
        rows.append((r[query_key], r["g"]))
        size += r["n"]
    if rows or out is None:
        out = one(rows) if out is None else out.unionByName(one(rows))
    return out


def _counter(queries: list[list[str] | None]):
    """A function from a column of lists of distinct pairs to their shares with each query, text by text."""
    n = len(queries)
    # an empty text's only pair is the empty one, which counts for nothing
    pairs = [(g, i) for i, q in enumerate(queries) for g in q or () if g]
    known = pa.array(sorted({g for g, _ in pairs}), pa.string())
    number = {g: k for k, g in enumerate(known.to_pylist())}
    gram, query = (np.array(x, dtype=np.int64) for x in ([number[g] for g, _ in pairs], [i for _, i in pairs]))
    order = np.argsort(gram, kind="stable")
    query = query[order]
    first = np.searchsorted(gram[order], np.arange(len(known) + 1))
    sizes = np.array([len(q or ()) for q in queries], dtype=np.int64)

    def run(lists: pa.Array) -> np.ndarray:
        own = np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64)
        row, grams = np.repeat(np.arange(len(own)), own), pc.index_in(lists.flatten(), value_set=known)
        hit = np.asarray(pc.is_valid(grams))
        row, g = row[hit], np.asarray(grams.drop_null()).astype(np.int64)
        times = first[g + 1] - first[g]
        place = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(first[g], times)
        both = np.bincount(np.repeat(row, times) * n + query[place], minlength=len(own) * n).reshape(len(own), n)
        return both / np.maximum(own[:, None] + sizes[None, :] - both, 1)

    return run


def jaccard_top(texts: DataFrame, queries: DataFrame, query_key: str, k: int, limit: int = QUERY_CHARS) -> DataFrame:
    """The ``k`` rows of ``texts`` (keys, text) nearest to each row of ``queries`` (query_key, text): query_key, rank, keys, jaccard.

    Equal shares are in order of the keys, nulls last; what has no pair in common is left out. No
    pair is made for each text and query: a task keeps ``k`` rows a query, whose last share bounds
    what still counts (``Best``), and sends those only. Query rows are ranked one by one, whatever their keys.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    keys = [c for c in texts.columns if c != "text"]
    texts = texts.select(*keys, bigrams("text").alias("__grams"))
    queries = queries.select(query_key, F.coalesce(F.length("text"), F.lit(0)).alias("n"), bigrams("text").alias("g"))
    schema = texts.drop("__grams").schema.add("__query", "integer").add("jaccard", "double")
    spark, out, rows, size = texts.sparkSession, None, [], 0

    def one(rows):
        sent = spark.sparkContext.broadcast([g for _, g in rows])

        def run(batches):
            best, kinds = Best(sent.value, k), None
            for b in batches:
                kinds = [b.column(c).type for c in keys]
                step = max(1, PAIRS // max(1, best.n))
                for part in (b.slice(i, step) for i in range(0, b.num_rows, step)):
                    best.add(part.column("__grams"), list(zip(*(part.column(c).to_pylist() for c in keys), strict=True)))
            found = [(*key, q, share) for q in range(best.n) for share, key in best.kept[q]]
            if found:
                *cols, query, share = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(cols, kinds, strict=True)), pa.array(query, pa.int32()), pa.array(share)], names=[*keys, "__query", "jaccard"])

        rank = F.row_number().over(W.partitionBy("__query").orderBy(F.desc("jaccard"), *(F.asc_nulls_last(c) for c in keys)))
        ids = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(rows)], queries.select(F.lit(0).alias("__query"), query_key).schema)
        top = texts.mapInArrow(run, schema).withColumn("rank", rank).filter(F.col("rank") <= k)
        return top.join(F.broadcast(ids), "__query").select(query_key, "rank", *keys, "jaccard")

    for r in queries.toLocalIterator():
        if rows and size + r["n"] > limit:
            out = one(rows) if out is None else out.unionByName(one(rows))
            rows, size = [], 0
        rows.append((r[query_key], r["g"]))
        size += r["n"]
    if rows or out is None:
        out = one(rows) if out is None else out.unionByName(one(rows))
    return out


def runs(sizes: np.ndarray, limit: int | None = None) -> Iterator[tuple[int, int]]:
    """(start, stop) of runs of ``sizes`` that sum up to ``limit`` (``ENTRIES``) at most, or of one larger size."""
    ends, start, limit = np.cumsum(sizes), 0, limit or ENTRIES
    while start < len(ends):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + limit, side="right")))
        yield start, stop
        start = stop


class Best:
    """The ``k`` best texts of each query so far.

    Two sets of x and y pairs with share s have at least o = s / (1 + s) * (x + y) pairs in common; so a text
    counts for a query only if both have o pairs (size bound), and only if one of its x - o + 1 rarest
    pairs, rare in the queries' lists, is the query's (prefix filter). Lists of other pairs are not read to
    find candidates, whose shares are then counted exactly.
    """

    def __init__(self, queries: list[list[str] | None], k: int):
        self.n, self.k = len(queries), k
        pairs = [(g, i) for i, q in enumerate(queries) for g in q or () if g]
        times: dict[str, int] = {}
        for g, _ in pairs:
            times[g] = times.get(g, 0) + 1
        order = sorted(times, key=lambda g: (times[g], g))  # rarest first, so a text's numbers in order are its prefix
        self.known, number = pa.array(order, pa.string()), {g: i for i, g in enumerate(order)}
        gram, query = (np.array(x, dtype=np.int64) for x in ([number[g] for g, _ in pairs], [i for _, i in pairs]))
        by = np.lexsort((query, gram))
        self.query, self.first = query[by], np.searchsorted(gram[by], np.arange(len(order) + 1))
        self.member = gram[by] * max(1, self.n) + self.query  # sorted
        self.sizes = np.array([sum(1 for g in q or () if g) for q in queries], dtype=np.int64)
        self.floor = np.zeros(self.n)  # the k-th best share, once there are k
        self.kept: list[list[tuple[float, tuple]]] = [[] for _ in queries]
        self.read = 0  # entries of lists

    def _lists(self, row: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, query) of every entry of the grams' lists."""
        times = self.first[gram + 1] - self.first[gram]
        self.read += int(times.sum())
        place = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(self.first[gram], times)
        return np.repeat(row, times), self.query[place]

    def add(self, lists: pa.Array, keys: list[tuple]) -> None:
        own = np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64)
        flat = lists.flatten()
        row = np.repeat(np.arange(len(own)), own)
        if not self.n or not len(flat):
            return
        gram = pc.index_in(flat, value_set=self.known)
        hit = np.asarray(pc.is_valid(gram))
        row, gram = row[hit], np.asarray(gram.drop_null()).astype(np.int64)
        by = np.lexsort((gram, row))
        row, gram = row[by], gram[by]
        have = np.bincount(row, minlength=len(own))
        begin = np.cumsum(have) - have
        # the least overlap that any query of a fitting size asks of a text of this size
        share = self.floor / (1 + self.floor)
        need = np.maximum(1, np.ceil(share[None, :] * (own[:, None] + self.sizes[None, :]) - 1e-9)).astype(np.int64)
        fits = (need <= have[:, None]) & (need <= self.sizes[None, :])
        least = np.where(fits, need, np.iinfo(np.int64).max).min(axis=1)
        prefix = np.where(fits.any(axis=1), have - least + 1, 0)
        front = np.arange(len(row)) - begin[row] < prefix[row]
        row_f, gram_f = row[front], gram[front]
        listed = np.zeros(len(own) * self.n, dtype=bool)  # at most PAIRS of them, or a text's
        for a, z in runs(self.first[gram_f + 1] - self.first[gram_f]):
            r, q = self._lists(row_f[a:z], gram_f[a:z])
            listed[r * self.n + q] = True
        pair = np.flatnonzero(listed)
        r, q = pair // self.n, pair % self.n
        some = fits[r, q]
        r, q = r[some], q[some]
        # exact counts of the candidates
        size, both = have[r], np.zeros(len(r))
        for a, z in runs(size):
            n = size[a:z]
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[r[a:z]], n)
            asked = gram[at] * self.n + np.repeat(q[a:z], n)
            found = self.member[np.searchsorted(self.member, asked).clip(max=len(self.member) - 1)] == asked
            both[a:z] = np.bincount(np.repeat(np.arange(z - a), n), weights=found, minlength=z - a)
        value = both / np.maximum(own[r] + self.sizes[q] - both, 1)
        good = (value > 0) & (value >= self.floor[q])
        order = np.argsort(q[good], kind="stable")
        r, q, value = r[good][order], q[good][order], value[good][order]
        for i in np.unique(q).tolist():
            a, z = np.searchsorted(q, [i, i + 1])
            self.kept[i] = sorted(self.kept[i] + [(v, keys[j]) for v, j in zip(value[a:z].tolist(), r[a:z].tolist(), strict=True)], key=lambda x: (-x[0], [(c is None, c) for c in x[1]]))[: self.k]
            if len(self.kept[i]) == self.k:
                self.floor[i] = self.kept[i][-1][0]
