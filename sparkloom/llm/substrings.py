"""Substring dedup by a log-structured fingerprint index.

The index is a list of immutable runs. A run holds, hashed and sorted by key so
that later batches merge-join with it without a shuffle of the run:

- ``copies``: the first document of each whole word sequence;
- ``anchors``: of every window of ``width`` words the smallest hash of ``gram``
  consecutive words (winnowing), with the first document that has it and whether
  it is live, that is known from two documents;
- ``windows``: for windows whose anchor is live, two 64-bit hashes and the first
  document that has the window.

Beside the runs each batch's texts are stored once, as they came, a file a task, and
never rewritten; an anchor known from one document has the file that holds it.

Two equal windows have equal anchors, so windows whose anchor occurs in one
document only cannot repeat and are never written: the index holds about one
anchor per 20 words, and windows only where text repeats. When a batch meets an
anchor that so far one old document has, that document's windows are added. A
match must agree in the second hash as well as the first (verification); the two
are made from independent hashes of the words. For those windows only the files of such
documents are read, not what other batches brought.

With a ``path`` the index outlives the session: a numbered manifest, written aside and
renamed, names the runs once a batch is in, and an index opened at the same path goes on from
there. It has one writer at a time; a batch that died has left no manifest and can be added again. A
run has as many buckets as keep each within ``BUCKET_BYTES``.

Runs have levels: ``fanout`` runs of one level are merged into one of the next
before another batch comes, so a batch meets at most (fanout - 1) * log(batches)
runs, and each entry is rewritten at most log(batches) times.

A window is removed where an earlier document has it: one of an earlier batch,
or one of the same batch with a smaller doc_id. A document that
comes again under its id in a later batch does not remove itself. With batches in
doc_id order this is the same as one pass over everything.

Edge cases: a null text has no words; a null doc_id is neither an earlier nor a
later document, so its text is kept whole and not indexed; rows that repeat a
doc_id are one document, whose own windows do not remove each other, and are
judged and returned one by one; fewer than ``width``
words are kept whole; equal windows within one document do not remove each
other; an empty batch makes an empty run; whole texts count, a very long one being
a batch of its own in memory; columns other than doc_id and text are not read,
whatever their names.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import Texts, U, Words, distinct_in_doc, lists, mix, pieces, rolling, sequence_hash, signed, slide
from .work import Workspace, about, not_about

WIDTH, GRAM = 50, 12
SECOND = 1  # seed of the words' second hash
BUCKET_BYTES = 256 << 20
TABLES = {"copies": ("sig", "sig LONG, sig2 LONG, n_words LONG, first LONG, known BOOLEAN"), "anchors": ("h", "h LONG, first LONG, at LONG, live BOOLEAN, wake BOOLEAN"), "windows": ("h1", "h1 LONG, h2 LONG, first LONG, last LONG, known BOOLEAN")}


def window_minima(w: Words, width: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each gram, and the smallest within each window of ``width`` words (0 across documents)."""
    g = rolling(w.hash, gram)
    span = width - gram + 1
    if len(g) < span:
        return g, np.empty(0, dtype=np.uint64)
    low = slide(g, span, np.minimum)
    at = np.arange(len(low))
    return g, np.where(at + width <= w.first[w.doc[at] + 1], low, U(0))


def anchors(w: Words, width: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, hash) of grams that are the smallest of some window."""
    g, low = window_minima(w, width, gram)
    if not len(low):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
    span = width - gram + 1
    edge = np.zeros(span - 1, dtype=np.uint64)
    top = slide(np.concatenate([edge, low, edge]), span, np.maximum)
    at = np.flatnonzero((top == g) & (g > 0))
    return distinct_in_doc(w.doc[at], g[at])


def _prints(width: int, gram: int):
    def run(batches):
        for whole in batches:
            for b in pieces(whole, "text"):
                w = Words(Texts(b.column("text")))
                doc, value = anchors(w, width, gram)
                whole1, whole2 = (sequence_hash(h, w.first[:-1], w.first[1:]) for h in (w.hash, w.rehashed(SECOND)))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(w.count.astype(np.int64)), signed(whole1), signed(whole2), lists(value, np.bincount(doc, minlength=b.num_rows)), b.column("at")], names=["doc_id", "n_words", "sig", "sig2", "anchors", "at"])

    return run


def _member(doc: np.ndarray, value: np.ndarray, col: pa.Array) -> np.ndarray:
    """Whether each (document, value) is in the document's list."""
    size = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(col), 0))
    have = np.asarray(col.flatten()).view(np.uint64)
    tag = lambda d, v: mix(v + d.astype(np.uint64) * U(0x9E3779B97F4A7C15))
    table = np.sort(tag(np.repeat(np.arange(len(size)), size), have))
    if not len(table):
        return np.zeros(len(doc), dtype=bool)
    key = tag(doc, value)
    return table[np.searchsorted(table, key).clip(max=len(table) - 1)] == key


def _windows(width: int, gram: int):
    def run(batches):
        for whole in batches:
            for b in pieces(whole, "text"):
                w = Words(Texts(b.column("text")))
                _, low = window_minima(w, width, gram)
                at = np.flatnonzero(low)
                at = at[_member(w.doc[at], low[at], b.column("live"))]
                h1, h2 = (rolling(h, width)[at] for h in (w.hash, w.rehashed(SECOND)))
                order = np.lexsort((h1, w.doc[at]))
                d, h1, h2 = w.doc[at][order], h1[order], h2[order]
                new = np.ones(len(d), dtype=bool)
                new[1:] = (d[1:] != d[:-1]) | (h1[1:] != h1[:-1])
                yield pa.RecordBatch.from_arrays([signed(h1[new]), signed(h2[new]), b.column("doc_id").take(pa.array(d[new]))], names=["h1", "h2", "doc_id"])

    return run


def _kept(width: int):
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for whole in batches:
            for b in pieces(whole, "text"):
                t = Texts(b.column("text"))
                w = Words(t)
                h = rolling(w.hash, width)
                at = np.arange(len(h))
                at = at[at + width <= w.first[w.doc[at] + 1]] if len(h) else at
                at = at[_member(w.doc[at], h[at], b.column("removed"))]
                cover = np.zeros(len(w.hash) + 1, dtype=np.int64)
                np.add.at(cover, at, 1)
                np.subtract.at(cover, at + width, 1)
                gone = np.cumsum(cover[:-1]) > 0
                copy = np.zeros(t.n, dtype=bool)
                some = np.flatnonzero(np.asarray(pa.compute.is_valid(b.column("copy"))))
                ends = w.first[:-1][some], w.first[1:][some]
                sig, sig2 = (sequence_hash(h, *ends).view(np.int64).tolist() for h in (w.hash, w.rehashed(SECOND) if len(some) else w.hash))
                for i, *own, known in zip(some.tolist(), sig, sig2, w.count[some].tolist(), b.column("copy").take(pa.array(some)).to_pylist(), strict=True):
                    copy[i] = dict(zip(("sig", "sig2", "n_words"), own, strict=True)) in known
                gone |= copy[w.doc]
                lost = np.bincount(w.doc[gone], minlength=t.n)
                text, cut = [], []
                for i in range(t.n):
                    words, out = t.raw(i).split(), []
                    if lost[i]:
                        g = gone[w.first[i] : w.first[i + 1]].astype(np.int8)
                        turn = np.flatnonzero(np.diff(np.concatenate([[0], g, [0]]))).tolist()
                        out = [{"start": s, "end": e} for s, e in zip(turn[::2], turn[1::2], strict=True)]
                        words = [x for x, y in zip(words, g.tolist(), strict=True) if not y]
                    text.append(b" ".join(words))
                    cut.append(out)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(w.count.astype(np.int64)), pa.array(lost.astype(np.int64)), pa.array(cut, spans), pa.array(text, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "spans", "kept"])

    return run


#: ``first`` is another document of an earlier batch, or one of the same batch with a smaller doc_id.
EARLIER = "first < doc_id OR (known AND first > doc_id)"
COPY = "array<struct<sig:bigint,sig2:bigint,n_words:bigint>>"
RESULT = "doc_id long, n_words long, n_removed long, spans array<struct<start:int,end:int>>, kept string"


WINDOWS = "h1 long, h2 long, doc_id long"


def _same(x: Column, y: Column) -> Column:
    """x = y, as a condition that is no join key: the join stays on the key by which runs are bucketed and sorted."""
    return x.bitwiseXOR(y).isin(0)


class SubstringIndex:
    """The index; ``add`` takes a batch and returns its documents without what was there before."""

    def __init__(self, spark: SparkSession, width: int = WIDTH, gram: int = GRAM, fanout: int = 2, buckets: int | None = None, path: str | None = None):
        self.spark, self.width, self.gram, self.fanout = spark, width, gram, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.ws = Workspace(spark, "substrings")
        self.home = Workspace(spark, "index", keep=path) if path else self.ws
        self.runs: list[tuple[int, dict[str, DataFrame]]] = []  # (level, tables)
        self.places: dict[int, dict[str, tuple[str, int]]] = {}  # of each run, by the id of its dictionary: folder and buckets
        self.batches, self.stale, self.saved = 0, [], -1
        if path:
            self._open()

    def _open(self) -> None:
        fs, p = self.home.fs(f"{self.home.path}/manifest")
        numbers = sorted(int(f.getPath().getName()[:-5]) for f in fs.listStatus(p) if f.getPath().getName()[:1] not in "._") if fs.exists(p) else []
        if not numbers:
            return
        m = json.loads(self.spark.read.text(f"{self.home.path}/manifest/{numbers[-1]}.json", wholetext=True).first()[0])
        if (m["width"], m["gram"]) != (self.width, self.gram):
            raise ValueError(f"{self.home.path}: the index is of windows of {m['width']} and grams of {m['gram']} words")
        self.batches, self.stale, self.saved = m["batches"], m["stale"], numbers[-1]
        for level, tables in m["runs"]:
            run = {name: self.home.reopened(f"{self.home.path}/{folder}", TABLES[name][1], TABLES[name][0], n) for name, (folder, n) in tables.items()}
            self.runs.append((level, run))
            self.places[id(run)] = {name: tuple(x) for name, x in tables.items()}

    def _save(self) -> None:
        """The next manifest, whole under its name or not there."""
        if not self.home.keep:
            return
        self.saved += 1
        m = {"width": self.width, "gram": self.gram, "batches": self.batches, "stale": self.stale, "runs": [(level, self.places[id(run)]) for level, run in self.runs]}
        fs, aside = self.home.fs(f"{self.home.path}/manifest/_{uuid.uuid4().hex}")
        stream = fs.create(aside, False)
        stream.write(json.dumps(m).encode())
        stream.close()
        if not fs.rename(aside, self.home.fs(f"{self.home.path}/manifest/{self.saved}.json")[1]):
            raise RuntimeError(f"{self.home.path}: another writer has added a batch meanwhile")

    def _put(self, df: DataFrame, name: str, buckets: int | None = None) -> tuple[DataFrame, tuple[str, int]]:
        n = buckets or self.buckets
        table = self.home.bucketed(df, name, TABLES[name][0], n)
        return table, (self.home.places[name].rsplit("/", 1)[-1], n)

    def _texts(self, at: list[int]) -> DataFrame:
        """The texts of the files ``at``, of whatever batches."""
        paths = [f"{self.home.path}/texts/batch={a >> 32}/part={a & 0xFFFFFFFF}" for a in at]
        read = self.spark.read.schema("doc_id LONG, text STRING")
        return read.parquet(*paths) if paths else self.spark.createDataFrame([], "doc_id long, text string")

    def add(self, batch: DataFrame) -> DataFrame:
        """``batch`` (doc_id, text): doc_id, n_words, n_removed, spans of removed words, kept text."""
        self.compact()
        ws, width, gram, runs = self.ws, self.width, self.gram, [tables for _, tables in self.runs]
        # every task writes a file of its own, whose number is known
        where = f"{self.home.path}/texts/batch={self.batches}"
        batch.select("doc_id", "text", F.spark_partition_id().alias("part")).write.option("compression", "zstd").partitionBy("part").mode("overwrite").parquet(where)
        batch = self.spark.read.schema("doc_id LONG, text STRING, part INT").parquet(where).withColumn("at", F.lit(self.batches << 32).cast("long") + F.col("part")).drop("part")
        docs = batch.filter("doc_id IS NOT NULL")
        prints = ws.write(docs.mapInArrow(_prints(width, gram), "doc_id long, n_words long, sig long, sig2 long, anchors array<long>, at long"), "prints").filter(F.col("n_words") >= width)
        # whole copies: only the first document of equal word sequences goes on
        first = prints.groupBy("sig", "sig2", "n_words").agg(F.min("doc_id").alias("first")).withColumn("old", F.lit(None).cast("long"))
        for run in runs:
            old = run["copies"].select(F.col("sig").alias("s"), F.col("sig2").alias("s2"), F.col("n_words").alias("n"), F.col("first").alias("f"))
            first = first.join(old, (F.col("sig") == F.col("s")) & _same(F.col("sig2"), F.col("s2")) & _same(F.col("n_words"), F.col("n")), "left").select("sig", "sig2", "n_words", "first", F.coalesce("old", "f").alias("old"))
        copies, copies_at = self._put(first.select("sig", "sig2", "n_words", F.coalesce("old", "first").alias("first"), F.col("old").isNotNull().alias("known")), "copies")
        keyed = prints.join(copies.hint("merge"), ["sig", "sig2", "n_words"])
        alone = ws.write(keyed.filter("first = doc_id").select("doc_id", "anchors", "at"), "alone")
        # of rows that share a doc_id only those with a copied word sequence are copies
        again = keyed.filter(EARLIER).select("doc_id", F.struct("sig", "sig2", "n_words").alias("c")).groupBy("doc_id").agg(F.collect_set("c").alias("copy"))
        # anchors of this batch against each run's
        each = alone.select("doc_id", "at", F.explode("anchors").alias("h"))
        state = each.groupBy("h").agg(F.min(F.struct("doc_id", "at")).alias("f"), F.max("doc_id").alias("last"), (F.min("at") < F.max("at")).alias("apart"))
        state = state.select("h", F.col("f.doc_id").alias("first"), F.col("f.at").alias("at"), "last", "apart").withColumn("old", F.lit(None).cast("long")).withColumn("old_at", F.lit(None).cast("long")).withColumn("was_live", F.lit(False))
        for run in runs:
            old = run["anchors"].select("h", F.col("first").alias("f"), F.col("at").alias("a"), F.col("live").alias("l"))
            state = state.join(old, "h", "left").select("h", "first", "at", "last", "apart", F.coalesce("old", "f").alias("old"), F.coalesce("old_at", "a").alias("old_at"), (F.col("was_live") | F.coalesce("l", F.lit(False))).alias("was_live"))
        known = F.col("old").isNotNull()
        # also live if rows of one document in several files have it, since an anchor remembers one file
        state = state.select("h", F.coalesce("old", "first").alias("first"), F.coalesce("old_at", "at").alias("at"), (known | (F.col("first") < F.col("last")) | F.col("apart")).alias("live"), (known & ~F.col("was_live")).alias("wake"))
        marks, marks_at = self._put(state, "anchors")
        live = marks.filter("live").select("h")
        touched = ws.write(each.join(live, "h").groupBy("doc_id").agg(F.collect_list("h").alias("live")), "touched")
        own = ws.write(about(docs, touched).join(touched.hint("merge"), "doc_id").mapInArrow(_windows(width, gram), WINDOWS), "own")
        found = own.select("h1", "h2", "doc_id", F.col("doc_id").alias("new"))
        if runs:
            wake = marks.filter("wake")
            woken = ws.write(wake.groupBy(F.col("first").alias("doc_id")).agg(F.collect_list("h").alias("live")), "woken")
            files = [r["at"] for r in wake.select("at").distinct().collect()]  # as many numbers as there are files of texts at most
            old = about(self._texts(files), woken).join(woken.hint("merge"), "doc_id").mapInArrow(_windows(width, gram), WINDOWS)
            found = found.unionByName(old.withColumn("new", F.lit(None).cast("long")))
        found = found.groupBy("h1", "h2").agg(F.min("new").alias("first"), F.max("new").alias("last"), F.min(F.when(F.col("new").isNull(), F.col("doc_id"))).alias("old"))
        for run in runs:
            old = run["windows"].select("h1", F.col("h2").alias("check"), F.col("first").alias("f"))
            found = found.join(old, (found["h1"] == old["h1"]) & _same(F.col("h2"), F.col("check")), "left").select(found["h1"], "h2", "first", "last", F.coalesce("old", "f").alias("old"))
        found = found.select("h1", "h2", F.coalesce("old", "first").alias("first"), "last", F.col("old").isNotNull().alias("known"))
        windows, windows_at = self._put(found, "windows")
        # read as plain files here, so that a window that very many documents share can be split
        path = windows.inputFiles()
        doubled = self.spark.read.schema(windows.schema).parquet(*path) if path else windows
        doubled = doubled.filter("last IS NOT NULL AND (known OR first < last)").select("h1", "h2", "first", "known")
        removed = own.join(doubled, ["h1", "h2"]).filter(EARLIER).groupBy("doc_id").agg(F.collect_set("h1").alias("removed"))
        removed = ws.write(removed.join(again, "doc_id", "full"), "removed")
        run = {"copies": copies, "anchors": marks, "windows": windows}
        self.places[id(run)] = {"copies": copies_at, "anchors": marks_at, "windows": windows_at}
        self.runs.append((0, run))
        self.batches += 1
        self._save()
        batch = batch.select("doc_id", "text")
        whole = not_about(batch, removed).withColumns({"removed": F.lit(None).cast("array<long>"), "copy": F.lit(None).cast(COPY)})
        judged = about(batch, removed).join(removed.hint("merge"), "doc_id", "left").select("doc_id", "text", "removed", "copy").unionByName(whole)
        return judged.mapInArrow(_kept(width), RESULT)

    def compact(self) -> None:
        """Merges each ``fanout`` runs of a level into one of the next; old runs stay on disk while results read them, those of a kept index until the next merge."""
        fold = {
            "copies": (("sig", "sig2", "n_words"), (F.min("first").alias("first"), F.lit(False).alias("known"))),
            "anchors": (("h",), (F.min(F.struct("first", "at")).alias("f"), F.max("live").alias("live"), F.lit(False).alias("wake"))),
            "windows": (("h1", "h2"), (F.min("first").alias("first"), F.max("last").alias("last"), F.lit(False).alias("known"))),
        }
        level, gone = 0, []
        while any(k >= level for k, _ in self.runs):
            old = [tables for k, tables in self.runs if k == level]
            if len(old) >= self.fanout:
                merged, places = {}, {}
                for name, (keys, values) in fold.items():
                    both = reduce(DataFrame.unionByName, (r[name] for r in old)).groupBy(*keys).agg(*values)
                    if name == "anchors":
                        both = both.select("h", "f.first", "f.at", "live", "wake")
                    merged[name], places[name] = self._put(both, name, max(self.buckets, -(-sum(self._bytes(r, name) for r in old) // BUCKET_BYTES)))
                self.places[id(merged)] = places
                gone += [place for r in old for place, _ in self.places[id(r)].values()]
                self.runs = [(k, r) for k, r in self.runs if k != level] + [(level + 1, merged)]
            level += 1
        if gone and self.home.keep:
            for place in self.stale:
                self.home.drop(f"{self.home.path}/{place}")
            self.stale = gone
            self._save()

    def _bytes(self, run: dict, name: str) -> int:
        fs, p = self.home.fs(f"{self.home.path}/{self.places[id(run)][name][0]}")
        return fs.getContentSummary(p).getLength()


def dedup(spark: SparkSession, docs: DataFrame, batches: int = 3, width: int = WIDTH) -> DataFrame:
    """All of ``docs`` through an index, in ``batches`` of ascending doc_id."""
    shares = [i / batches for i in range(1, batches)]
    cuts = (docs.agg(F.percentile_approx("doc_id", shares, 1000)).first()[0] or []) if shares else []
    index, out, low = SubstringIndex(spark, width), None, None
    for cut in [*sorted(set(cuts)), None]:
        part = docs
        if low is not None:
            part = part.filter(F.col("doc_id") > low)
        if cut is not None:
            part = part.filter((F.col("doc_id") <= cut) | F.col("doc_id").isNull() if low is None else F.col("doc_id") <= cut)
        done = index.add(part)
        out, low = done if out is None else out.unionByName(done), cut
    return out


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of all ``documents``, through an index in three batches: the first two are compacted before the third."""
    out = dedup(spark, spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, unnest(range(1, len(w) - 48)) AS i, unnest(list_transform(range(1, len(w) - 48), lambda i: md5(array_to_string(w[i : i + 49], ' ')))) AS h FROM d WHERE len(w) >= 50
), first AS (
  SELECT h, min(doc_id) AS f FROM win GROUP BY h HAVING min(doc_id) < max(doc_id)
), gone AS (
  SELECT DISTINCT doc_id, i + unnest(range(50)) AS p FROM win JOIN first USING (h) WHERE f < doc_id
), words AS (
  SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM d
), kept AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""
