"""Ranked lexical search over a block-max index in shards.

The index is a table with one row per (shard, term), written where the texts are
read and so without a shuffle: a shard is some megabytes of documents, numbered in
order of doc_id, and a row has the term's documents, what a unit of the term's weight
adds to each one's score (``impact``), and blocks.

Blocks. A dynamic program cuts each list where the bound errs least: over all ways
of cutting it into blocks of ``MOST`` postings at most, the sum of (size * largest
impact) plus a price a block is smallest. Lists of a shard go through it abreast.

Search. Each shard is searched by itself, with exact results. The k-th best score so
far, which a task carries from shard to shard, is WAND's floor; to start, documents with
the query's best terms and the highest bounds are scored. Lists whose largest values
together stay below the floor are no pivots: a document in these alone cannot reach it.
For the others, a document's bound is the sum of weight * block maximum over the blocks
that span it; it changes only where blocks begin and end, so one running sum has it for
all documents at once. Documents in a pivot list whose bound reaches the floor are
scored, equal ones included, so nothing is lost, and blocks that span none are skipped.
Tasks send k rows a query, which a window ranks.

Weights need each term's count of documents, which is the sum of the lists' lengths;
impacts need the number of documents and of all terms, which a first pass counts. Terms
of a shard are told apart by 64-bit hashes, terms of queries and lists by their bytes.

Edge cases: a null or text without terms has none and is never found, nor counted; a
null doc_id is ranked behind equal scores with one; rows that repeat a doc_id are
documents of their own; a query without id or text is left out, one without terms or
known terms has no rows; rows that repeat a query's id are ranked one by one; terms
that nearly all documents have weigh 0 and add nothing; empty tables give no rows;
whole texts count, a very long one being a shard; columns of other names are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .decontam import blocks as query_blocks
from .text import Texts, Words, lists, pieces
from .work import Workspace

TOP = 50
MOST = 32  # postings of a block
PRICE = 4  # of a block, in mean impacts of its list
SHARD_BYTES = 8 << 20

#: ASCII bytes that are no letter or digit stand between terms.
BETWEEN = np.zeros(256, dtype=bool)
BETWEEN[0x00:0x30] = BETWEEN[0x3A:0x41] = BETWEEN[0x5B:0x61] = BETWEEN[0x7B:0x80] = True

INDEX = "shard long, term string, df int, docs array<int>, impacts array<int>, ends array<int>, tops array<int>, ids array<long>"


def terms(texts: Texts) -> Words:
    return Words(texts, lower=True, sep=BETWEEN)


def _count(batches):
    for whole in batches:
        for b in pieces(whole, "text"):
            n = terms(Texts(b.column("text"))).count
            yield pa.RecordBatch.from_arrays([pa.array([int((n > 0).sum())]), pa.array([int(n.sum())])], names=["docs", "terms"])


def impacts(tf: np.ndarray, size: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What a unit of weight adds for a term that is ``tf`` times in a document of ``size`` terms (fixed formula)."""
    m = 100 - 50 + 50 * size * n_docs // n_terms
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


def cut(values: np.ndarray, first: np.ndarray, most: int = MOST, price: float = PRICE) -> tuple[np.ndarray, np.ndarray]:
    """(ends, how many per list) of the cheapest blocks of the lists values[first[i]:first[i + 1]].

    A block costs its size times its largest value, and ``price`` times the list's mean value.
    """
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    longest = int(n.max(initial=0))
    active = len(n) - np.searchsorted(n[order][::-1], np.arange(longest), side="right")  # lists with more than t values
    mean = np.add.reduceat(values, first[:-1]) / n if len(values) else np.empty(0)
    fee = price * mean[order]
    top, before = np.zeros((len(n), most)), np.full((len(n), most), np.inf)
    cost = np.zeros(len(n))
    last = np.zeros(len(values), dtype=np.int32)  # size of the last block of the best cut up to each value
    at = first[:-1][order]
    for t in range(longest):
        a, col = int(active[t]), t % most
        v = values[at[:a] + t].astype(np.float64)
        before[:a, col] = cost[:a] + fee[:a]
        top[:a, col] = 0
        np.maximum(top[:a], v[:, None], out=top[:a])
        size = (t - np.arange(most)) % most + 1
        total = top[:a] * size + before[:a]
        best = total.argmin(axis=1)
        cost[:a] = total[np.arange(a), best]
        last[at[:a] + t] = size[best]
    ends, place = np.zeros(len(values) + 1, dtype=bool), first[1:].copy()
    live = np.flatnonzero(place > first[:-1])
    while len(live):  # back from the ends, all lists abreast
        ends[place[live]] = True
        place[live] -= last[place[live] - 1]
        live = live[place[live] > first[live]]
    where = np.flatnonzero(ends)
    owner = np.searchsorted(first[1:], where, side="left")
    return where - first[owner], np.bincount(owner, minlength=len(n))


def _index(n_docs: int, n_terms: int):
    def run(batches):
        ctx, number = TaskContext.get(), 0
        task = (ctx.partitionId() if ctx else 0) << 32
        for whole in batches:
            for b in pieces(whole, "text", SHARD_BYTES):
                b = b.take(pa.compute.sort_indices(b, sort_keys=[("doc_id", "ascending")]))  # nulls last
                shard, number = task + number, number + 1
                w = terms(Texts(b.column("text")))
                order = np.argsort(w.hash, kind="stable")
                h, d = w.hash[order], w.doc[order]
                new = np.ones(len(h), dtype=bool)
                new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
                post = np.flatnonzero(new)  # one of each (term, document)
                tf = np.diff(np.append(post, len(h)))
                h, d = h[post], d[post]
                value = impacts(tf, w.count[d], n_docs, n_terms)
                head = np.flatnonzero(np.append(True, h[1:] != h[:-1])[: len(h)])
                first = np.append(head, len(h))
                ends, n_blocks = cut(value, first)
                stop = ends + np.repeat(first[:-1], n_blocks)
                tops = np.maximum.reduceat(value, np.append(0, stop[:-1])) if len(stop) else value
                word = order[post[head]]
                names = [w.buf[s:e].tobytes() for s, e in zip(w.starts[word].tolist(), w.ends[word].tolist(), strict=True)]
                df = np.diff(first)
                ints = lambda x, n: lists(x.astype(np.int32), n)
                cols = [pa.array(np.full(len(df), shard)), pa.array(names, pa.binary()).cast(pa.string()), pa.array(df.astype(np.int32)), ints(d, df), ints(value, df), ints(ends, n_blocks), ints(tops, n_blocks), pa.nulls(len(df), pa.list_(pa.int64()))]
                own = [pa.array([shard]), *(pa.nulls(1, c.type) for c in cols[1:-1]), pa.array([b.column("doc_id").to_pylist()], pa.list_(pa.int64()))]
                for c in (cols, own):
                    yield pa.RecordBatch.from_arrays(c, names=["shard", "term", "df", "docs", "impacts", "ends", "tops", "ids"])

    return run


def _ranges(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """begin[i], ..., end[i] - 1 of each i in turn."""
    size = end - begin
    return np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin, size)


class Shard:
    """The lists of one shard that some query asks for, end to end."""

    def __init__(self, rows: list[dict]):
        self.ids, self.known, found = np.empty(0, dtype=np.int64), np.empty(0, dtype=bool), []
        for r in rows:
            if r["term"] is None:
                self.known = np.asarray(pa.compute.is_valid(r["ids"]))
                self.ids = np.asarray(pa.compute.fill_null(r["ids"], 0))
            else:
                found.append(r)
        stack = lambda c: np.concatenate([np.empty(0, dtype=np.int32), *(np.asarray(r[c]) for r in found)]).astype(np.int64)
        self.docs, self.impacts, self.tops, ends = (stack(c) for c in ("docs", "impacts", "tops", "ends"))
        size, n_blocks = np.array([len(r["docs"]) for r in found], dtype=np.int64), np.array([len(r["ends"]) for r in found], dtype=np.int64)
        base = np.cumsum(size) - size
        self.end = ends + np.repeat(base, n_blocks)
        self.begin = np.append(0, self.end[:-1])[: len(self.end)]  # lists stand end to end, and so do their blocks
        self.low, self.high = (self.docs[self.begin], self.docs[self.end - 1] + 1) if len(self.end) else (self.begin, self.end)
        stop = np.cumsum(n_blocks)
        self.blocks = {r["term"]: (int(z - n), int(z)) for r, n, z in zip(found, n_blocks, stop, strict=True)}

    def _score(self, block: np.ndarray, weight: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, int]:
        """Scores of the ``wanted`` documents, from the blocks that span one; and how many postings these have."""
        seen = np.append(0, np.cumsum(wanted))
        on = seen[self.high[block]] > seen[self.low[block]]
        block, weight = block[on], weight[on]
        at = _ranges(self.begin[block], self.end[block])
        return np.bincount(self.docs[at], weights=self.impacts[at] * np.repeat(weight, self.end[block] - self.begin[block]), minlength=len(wanted)), len(at)

    def _holders(self, spans: list[tuple[int, int, int]], keep: np.ndarray | None = None) -> np.ndarray:
        """Whether each document is in one of the lists; of ``keep``, only blocks that span one are looked into."""
        out = np.zeros(len(self.ids), dtype=bool)
        block = np.concatenate([np.empty(0, dtype=np.int64), *(np.arange(a, z) for a, z, _ in spans)])
        if keep is not None:
            seen = np.append(0, np.cumsum(keep))
            block = block[seen[self.high[block]] > seen[self.low[block]]]
        out[self.docs[_ranges(self.begin[block], self.end[block])]] = True
        return out if keep is None else out & keep

    def search(self, query: list[tuple[str, int]], k: int, floor: float = 0) -> tuple[np.ndarray, np.ndarray, int]:
        """(documents, scores, postings scored) of all that can be among the k best, given that k others reach ``floor``."""
        spans = [(*self.blocks[t], w) for t, w in query if w > 0 and t in self.blocks]
        if not spans:
            return np.empty(0, dtype=np.int64), np.empty(0), 0
        spans.sort(key=lambda s: -s[2] * self.tops[s[0] : s[1]].max())  # lists of the largest bounds first
        block = np.concatenate([np.arange(a, z) for a, z, _ in spans])
        weight = np.repeat(np.array([w for *_, w in spans], dtype=np.float64), [z - a for a, z, _ in spans])
        n, most = len(self.ids), self.tops[block] * weight
        bound = np.cumsum(np.bincount(self.low[block], weights=most, minlength=n + 1) - np.bincount(self.high[block], weights=most, minlength=n + 1))[:n]
        held = np.cumsum([self.end[z - 1] - self.begin[a] for a, z, _ in spans])
        read = 0
        if n > k and held[-1] > k:  # the k of the highest bounds, among the holders of the best terms
            first = np.where(self._holders(spans[: int(np.searchsorted(held, k)) + 1]), bound, 0)
            wanted = np.zeros(n, dtype=bool)
            wanted[np.argpartition(first, n - k)[n - k :]] = True
            wanted &= first > 0
            score, read = self._score(block, weight, wanted)
            if wanted.sum() == k:
                floor = max(floor, score[wanted].min())
        # lists that cannot reach the floor even together are no one's pivot
        rest = np.cumsum([w * self.tops[a:z].max() for a, z, w in reversed(spans)])
        pivots = spans[: len(spans) - int(np.searchsorted(rest, floor))] if floor else spans
        wanted = self._holders(pivots, (bound > 0) & (bound >= floor))
        score, more = self._score(block, weight, wanted)
        doc = np.flatnonzero(wanted & (score > 0))
        return doc, score[doc], read + more


def _search(sent, k: int):
    def run(batches: Iterator[pa.RecordBatch]):
        queries = sent.value  # of each: its terms with their weights
        best = [(np.empty(0), np.empty(0, dtype=bool), np.empty(0, dtype=np.int64)) for _ in queries]

        def take(rows):
            shard = Shard(rows)
            for i, query in enumerate(queries):
                doc, score, _ = shard.search(query, k, best[i][0][k - 1] if len(best[i][0]) == k else 0)
                if len(doc):
                    all_of = [np.concatenate(x) for x in zip(best[i], (score, shard.known[doc], shard.ids[doc]), strict=True)]
                    order = np.lexsort((all_of[2], ~all_of[1], -all_of[0]))[:k]
                    best[i] = tuple(x[order] for x in all_of)

        rows, at = [], None
        for b in batches:
            columns = {n: b.column(n) for n in ("term", "docs", "impacts", "ends", "tops", "ids")}
            for j, shard in enumerate(b.column("shard").to_pylist()):
                if shard != at and rows:
                    take(rows)
                    rows = []
                at = shard
                rows.append({n: c[j].as_py() if n == "term" else c[j].values for n, c in columns.items()})
        if rows:
            take(rows)
        for i, (score, known, ids) in enumerate(best):
            if len(score):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(score), i, dtype=np.int32)), pa.array(ids, mask=~known), pa.array(score.astype(np.int64))], names=["query", "doc_id", "score"])

    return run


class SearchIndex:
    """An index over ``docs`` (doc_id, text), written under the shared folder."""

    def __init__(self, spark: SparkSession, docs: DataFrame):
        self.spark, self.ws = spark, Workspace(spark, "search")
        docs = docs.select("doc_id", "text")
        n = docs.mapInArrow(_count, "docs long, terms long").agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()
        self.n_docs, self.n_terms = n[0], n[1]
        self.table = self.ws.write(docs.mapInArrow(_index(self.n_docs, max(1, self.n_terms)), INDEX), "index")

    def weight(self, df: int) -> int:
        """Weight of a term that ``df`` documents have (fixed formula)."""
        return math.floor(1000 * math.log((2 * self.n_docs + 2) / (2 * df + 1)))

    def search(self, queries: DataFrame, k: int = TOP) -> DataFrame:
        """(item_id, rank, doc_id, score): the ``k`` best documents for each row of ``queries`` (item_id, text)."""
        out = None
        for rows in query_blocks(queries):
            w = terms(Texts(pa.array([t for _, t in rows], pa.string())))
            asked = [sorted({w.buf[s:e].tobytes().decode() for s, e in zip(w.starts[a:z].tolist(), w.ends[a:z].tolist(), strict=True)}) for a, z in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)]
            words = self.spark.createDataFrame([(t,) for t in sorted(set().union(*asked))], "term string")  # a block's terms: bounded like the block
            found = self.table.join(F.broadcast(words), "term", "left_semi")
            weight = {r["term"]: self.weight(r["df"]) for r in found.groupBy("term").agg(F.sum("df").alias("df")).collect()}
            sent = self.spark.sparkContext.broadcast([[(t, weight[t]) for t in one if t in weight] for one in asked])
            lists_ = found.unionByName(self.table.filter("term IS NULL")).repartition("shard").sortWithinPartitions("shard")
            got = lists_.mapInArrow(_search(sent, k), "query int, doc_id long, score long")
            rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
            ids = F.broadcast(self.spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "query int, item_id long"))
            got = got.withColumn("rank", rank).filter(F.col("rank") <= k).join(ids, "query").select("item_id", "rank", "doc_id", "score")
            out = got if out is None else out.unionByName(got)
        return out if out is not None else self.spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of each benchmark item."""
    index = SearchIndex(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return index.search(spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents
), s AS (
  SELECT CAST(count(*) FILTER (len(t) > 0) AS BIGINT) AS n_docs, CAST(coalesce(sum(len(t)), 0) AS BIGINT) AS n_terms FROM d
), u AS (
  SELECT doc_id, CAST(len(t) AS BIGINT) AS n, unnest(t) AS term FROM d
), p AS (
  SELECT doc_id, term, n, count(*) AS tf FROM u GROUP BY doc_id, term, n
), q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), w AS (
  SELECT term, CAST(floor(1000 * ln((2 * (SELECT n_docs FROM s) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p GROUP BY term
), x AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN p USING (term), s GROUP BY item_id, doc_id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM x WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50
"""
