"""MinHash near-dedup with bottom-k sketches of one hash function.

1. Each text's shingles are hashed once; the ``K`` smallest hashes are its
   sketch. Texts with equal shingle sets are one class with one member (the
   smallest doc_id) that goes on, however many copies there are.
2. The smallest sketch values of each class go into inverted lists. Two sets
   with a Jaccard similarity of at least 0.8 share each of the smallest values
   of their union with that probability, so they miss each other in all lists
   with probability 0.2 ** 12 at most.
3. In each list every member is compared with a few leaders, so what a list
   emits grows with its length only. Once the components of the links found so are
   known, members outside of a list's largest component are compared with all
   members of other components: links inside a component need no pairs.
   Lists longer than ``HOT`` come from passages that many texts share, or from
   large groups of near copies. A class with enough other values is found by
   those (its hot values alone cannot make up a link) and leaves the long lists.
   What is left of a long list is compared block by block on full sets; in shorter
   lists a pair across components is emitted. Nothing is capped.
4. Candidate pairs pass if the estimate from the ``K`` smallest values of the
   united sketches can reach the threshold, then both full sets are compared.
5. Components of the verified links; the smallest doc_id of each is kept.

Edge cases: a null or wordless text has an empty set and links with nothing;
fewer words than a shingle's make one shingle of them all; a null doc_id takes
part only as a copy of a class that has an id, and is its own kept document
otherwise; rows that repeat a doc_id count as one document: what links with
either is linked; equal similarities are all links; empty tables give no rows;
whole texts count, a very long one being a batch of its own; columns other than
doc_id, text and those asked for by ``carry`` are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import components
from .text import Texts, U, Words, lists, mix, pieces, rolling, sequence_hash
from .work import Workspace, about

K = 64  # values of a sketch
LISTED = 24  # values looked at for the lists
SPARE = 12  # values listed where none is hot
ENOUGH = 14  # other values, of LISTED, that let a class leave the long lists
HOT = 32  # longest list whose pairs across components are emitted one by one
BLOCK_ROWS, BLOCK_VALUES = 1024, 1 << 19  # sets, and shingles of all of them, in a block that is compared with another
NEED = 8  # values of LISTED that a pair at the threshold shares, but for a probability of 1e-7
LED, LEADERS = 3, 6  # long lists in which a class meets leaders, and leaders by hash
SLACK = 5.2  # standard errors allowed to estimates


def shingles(t: Texts, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, hash) pairs in order; hashes have 63 bits."""
    w = Words(t, lower=True)
    grams = rolling(w.hash, width)
    at = np.arange(len(grams))
    if len(grams):
        whole = at + width <= w.first[w.doc[at] + 1]
        doc, value = w.doc[at][whole], grams[whole]
    else:
        doc, value = np.empty(0, dtype=np.int64), grams
    few = np.flatnonzero((w.count > 0) & (w.count < width))
    if len(few):
        short = sequence_hash(w.hash, w.first[few], w.first[few + 1])
        doc, value = np.concatenate([doc, few]), np.concatenate([value, short])
    value = value >> U(1)
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    keep = np.ones(len(doc), dtype=bool)
    keep[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    return doc[keep], value[keep]


def _sums(doc: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Sum of ``value`` per text, modulo 2**64; ``doc`` is in order."""
    pre = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(value)])
    at = np.searchsorted(doc, np.arange(n + 1))
    return pre[at[1:]] - pre[at[:-1]]


def signatures(doc: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set, whatever the order of its members."""
    return tuple(_sums(doc, mix(value ^ U(s)), n).view(np.int64) for s in (0x1234567, 0x89ABCDEF01))


def _prints(width: int, carry: list[str]):
    def run(batches):
        for whole in batches:
            for b in pieces(whole, "text"):
                t = Texts(b.column("text"))
                doc, value = shingles(t, width)
                size = np.bincount(doc, minlength=t.n)
                rank = np.arange(len(doc)) - np.repeat(np.cumsum(size) - size, size)
                low = rank < K
                sig, sig2 = signatures(doc, value, t.n)
                own = [pa.array(size.astype(np.int64)), pa.array(sig), pa.array(sig2), lists(value[low], np.minimum(size, K))]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *own, *(b.column(c) for c in carry)], names=["doc_id", "n", "sig", "sig2", "sketch", *carry])

    return run


def _sets(width: int):
    def run(batches):
        for whole in batches:
            for b in pieces(whole, "text"):
                t = Texts(b.column("text"))
                doc, value = shingles(t, width)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), lists(value, np.bincount(doc, minlength=t.n))], names=["node", "members"])

    return run


def _arrays(col: pa.Array) -> list[np.ndarray]:
    flat, offs = np.asarray(col.flatten()), np.concatenate([[0], np.cumsum(np.asarray(pa.compute.list_value_length(col)))])
    return [flat[s:e] for s, e in zip(offs[:-1], offs[1:], strict=True)]


def may_reach(x: np.ndarray, nx: int, y: np.ndarray, ny: int, threshold: float) -> bool:
    """Whether the union sketch's estimate of the similarity can be that of a pair at the threshold."""
    if nx <= K and ny <= K:  # both sketches are whole sets
        both = len(np.intersect1d(x, y, assume_unique=True))
        return both >= threshold * (nx + ny - both) - 1e-9
    union = np.union1d(x, y)[:K]
    both = len(np.intersect1d(np.intersect1d(x, y, assume_unique=True), union, assume_unique=True))
    return both >= len(union) * threshold - SLACK * np.sqrt(len(union) * threshold * (1 - threshold))


def _estimate(threshold: float):
    def run(batches):
        for b in batches:
            x, y = _arrays(b.column("x")), _arrays(b.column("y"))
            nx, ny = b.column("nx").to_pylist(), b.column("ny").to_pylist()
            ok = [may_reach(*p, threshold) for p in zip(x, nx, y, ny, strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _verify(percent: int):
    def run(batches):
        for b in batches:
            ok = []
            for x, y in zip(_arrays(b.column("x")), _arrays(b.column("y")), strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def overlaps(x: list[np.ndarray], y: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of all intersections of x's with y's sets, by products of a few thousand values at a time."""
    both = [*x, *y]
    flat, row = np.concatenate(both), np.repeat(np.arange(len(both)), [len(s) for s in both])
    # what only one side has is in no intersection
    common = np.intersect1d(flat[row < len(x)], flat[row >= len(x)])
    at = np.searchsorted(common, flat).clip(max=max(0, len(common) - 1))
    keep = common[at] == flat if len(common) else np.zeros(len(flat), dtype=bool)
    values, code, row = common, at[keep], row[keep]
    order = np.argsort(code, kind="stable")
    code, row = code[order], row[order]
    out = np.zeros((len(x), len(y)), dtype=np.float32)
    for lo in range(0, len(values), columns):
        s, e = np.searchsorted(code, [lo, lo + columns])
        grid = np.zeros((len(both), columns), dtype=np.float32)
        grid[row[s:e], code[s:e] - lo] = 1
        out += grid[: len(x)] @ grid[len(x) :].T
    return out


def _block_links(percent: int):
    """Links between a block of a long list's rest and a block of its members, on full sets.

    Only links that join components not joined by the block's earlier ones are returned.
    """

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        rest = np.asarray(table.column("rest").combine_chunks()).astype(bool)
        node, comp = (np.asarray(table.column(c)) for c in ("node", "component"))
        sets = _arrays(table.column("members").combine_chunks())
        n = np.array([len(s) for s in sets])
        p, q = np.flatnonzero(rest), np.flatnonzero(~rest)
        a, b = [], []
        if len(p) and len(q):
            both = overlaps([sets[i] for i in p], [sets[i] for i in q])
            linked = (100 * both >= percent * (n[p][:, None] + n[q][None, :] - both)) & (both > 0) & (comp[p][:, None] != comp[q][None, :])
            root: dict[int, int] = {}

            def find(c: int) -> int:
                while root.get(c, c) != c:
                    root[c] = root.get(root[c], root[c])
                    c = root[c]
                return c

            for i, j in zip(*np.nonzero(linked), strict=True):
                u, v = find(int(comp[p[i]])), find(int(comp[q[j]]))
                if u != v:
                    root[u] = v
                    a.append(int(min(node[p[i]], node[q[j]])))
                    b.append(int(max(node[p[i]], node[q[j]])))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


class NearDuplicates:
    """Classes, verified links and components of a table of texts (doc_id, text).

    ``carry``: other columns of ``docs`` that ``documents`` is to return; their names
    must differ from those of its own columns and start with two underscores.
    """

    def __init__(self, spark: SparkSession, docs: DataFrame, shingle: int = 5, percent: int = 80, carry: tuple[str, ...] = ()):
        self.ws = ws = Workspace(spark, "minhash")
        self.docs, self.shingle, self.percent, self.carry = docs.select("doc_id", "text"), shingle, percent, list(carry)
        more = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
        prints = ws.write(docs.select("doc_id", "text", *carry).mapInArrow(_prints(shingle, self.carry), f"doc_id long, n long, sig long, sig2 long, sketch array<long>{more}"), "prints")
        self.prints = prints.drop("sketch")
        self.classes = prints.filter("n > 0").groupBy("n", "sig", "sig2").agg(F.min("doc_id").alias("node"), F.first("sketch").alias("sketch"))
        self.classes = ws.write(self.classes, "classes")
        self.reps = self.classes.filter("node IS NOT NULL").select("node", "n", "sketch")
        self.links = self._links()
        self.components = ws.write(components(ws, self.links.unionByName(self._of_one_id())), "components")

    def _of_one_id(self) -> DataFrame:
        """Pairs (a, b) of classes that have rows of one doc_id: what links with either is linked."""
        own = self.prints.filter("n > 0 AND doc_id IS NOT NULL").select("doc_id", F.struct("n", "sig", "sig2").alias("k"))
        twice = own.groupBy("doc_id").agg(F.min("k").alias("low"), F.max("k").alias("high")).filter("low <> high").select("doc_id")
        twice = self.ws.write(twice, "twice")
        node = self.classes.select(F.struct("n", "sig", "sig2").alias("k"), "node")
        of = own.join(twice, "doc_id", "leftsemi").join(node, "k").select("doc_id", "node").distinct()
        return of.join(of.groupBy("doc_id").agg(F.min("node").alias("a")), "doc_id").filter("node <> a").select("a", F.col("node").alias("b")).distinct()

    def _near(self):
        """Whether the sizes ``n`` and ``nb`` allow a link."""
        return F.least("n", "nb") * 100 >= F.greatest("n", "nb") * self.percent

    def _listed(self) -> tuple[DataFrame, DataFrame]:
        """Members of the short lists (node, n, plain, v), and the classes that stay in long ones (node, n, common, hot)."""
        ws = self.ws
        low = F.slice("sketch", 1, LISTED)
        each = self.reps.select("node", F.explode(low).alias("v"))
        shared = ws.write(each.groupBy("v").count().filter("count > 1"), "shared")
        hot = shared.filter(F.col("count") > HOT)
        marked = ws.write(each.join(hot, "v").groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("count", "v"))), lambda x: x["v"]).alias("hot")), "marked")
        keyed = self.reps.join(marked, "node", "left").withColumn("hot", F.coalesce("hot", F.array().cast("array<long>")))
        cold = F.array_except(low, "hot")
        # a whole small set shares over 80 % of itself with a partner; a sample needs more to be sure
        enough = F.when(F.col("n") <= LISTED, F.floor(F.col("n") * (100 - self.percent) / 100) + 1).otherwise(ENOUGH)
        keyed = keyed.withColumn("cold", F.when(F.size("hot") == 0, F.slice("sketch", 1, SPARE)).otherwise(cold)).withColumn("stays", (F.size("hot") > 0) & (F.size(cold) < enough))
        listed = keyed.select("node", "n", (F.size("hot") == 0).alias("plain"), F.explode("cold").alias("v")).join(shared.select("v"), "v", "leftsemi")
        # a pair that no short list finds shares only hot values, and at least ``need`` of them; so it
        # shares one of each partner's rarest hot values but ``need`` - 1
        need = F.when(F.col("n") <= LISTED, F.ceil(F.col("n") * self.percent / 100)).otherwise(NEED)
        stay = keyed.withColumn("lists", (F.size("hot") - need + 1).cast("int")).filter("stays AND lists > 0")
        stay = stay.select("node", "n", F.size("hot").alias("common"), F.slice("hot", F.lit(1), F.col("lists")).alias("hot"))
        return ws.write(listed, "listed"), ws.write(stay, "stay")

    def _stars(self, member: DataFrame, chosen: list) -> DataFrame:
        """Pairs (a, b) of each member of a list (node, n, v, ...) with the list's leaders."""
        leaders = member.groupBy("v").agg(F.array_distinct(F.array(*chosen)).alias("leaders"))
        star = member.select("node", "n", "v").join(leaders, "v").select("node", "n", F.explode("leaders").alias("l")).select("node", "n", F.col("l.node").alias("b"), F.col("l.n").alias("nb"))
        return star.filter((F.col("node") != F.col("b")) & self._near()).select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b"))

    def _links(self) -> DataFrame:
        ws = self.ws
        listed, stay = self._listed()
        one = F.struct("node", "n")
        by_hash = [F.min_by(one, F.xxhash64("node", F.lit(i))) for i in range(LEADERS)]
        short = self._stars(listed, [F.min_by(one, F.col("node")), F.max_by(one, F.struct("n", -F.col("node"))), by_hash[0]])
        long = self._stars(stay.select("node", "n", "common", F.explode(F.slice("hot", 1, LED)).alias("v")), [F.max_by(one, F.struct("common", -F.col("node"))), F.max_by(one, F.struct("n", -F.col("node"))), *by_hash])
        links = self._verified(short.unionByName(long).distinct(), "star")
        # what the leaders' links leave apart
        comp = ws.write(components(ws, links), "first-components").withColumnRenamed("id", "node")
        return links.unionByName(self._across(listed, comp)).unionByName(self._rest(stay, comp))

    def _across(self, listed: DataFrame, comp: DataFrame) -> DataFrame:
        """Links between components in the short lists."""
        placed = listed.join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
        mixed = placed.groupBy("v").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("v")
        placed = self.ws.write(placed.join(mixed, "v", "leftsemi"), "mixed")
        other = placed.select("v", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("plain").alias("plain_b"), F.col("component").alias("component_b"))
        pairs = placed.join(other.hint("merge"), "v").filter((F.col("node") < F.col("b")) & (F.col("component") != F.col("component_b")) & self._near())
        pairs = pairs.groupBy(F.col("node").alias("a"), "b").agg(F.count("*").alias("shared"), F.min(F.col("plain") & F.col("plain_b") & (F.least("n", "nb") >= SPARE)).alias("plain"))
        # of SPARE values a pair at the threshold shares one or none with probability 2e-7
        return self._verified(pairs.filter(~F.col("plain") | (F.col("shared") > 1)).select("a", "b"), "across")

    def _rest(self, stay: DataFrame, comp: DataFrame) -> DataFrame:
        """Links between components in the long lists, block by block on full sets."""
        ws = self.ws
        # linked sets differ in size by a fifth at most, so they are in the same or neighbouring bands of size
        band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / self.percent))).cast("int")
        placed = ws.write(stay.join(comp, "node", "left").select("node", "hot", band.alias("band"), F.coalesce("component", "node").alias("component")), "placed")
        member = placed.select("node", "component", "band", F.explode("hot").alias("v"))
        count = member.groupBy("v", "component").count()
        led = count.groupBy("v").agg(F.max_by("component", F.struct("count", -F.col("component"))).alias("led"), (F.sum("count") - F.max("count")).alias("others")).filter("others > 0").drop("others")
        member = member.join(ws.write(led, "led"), "v")
        rest = member.filter("component <> led").withColumn("band", F.explode(F.array(F.col("band") - 1, "band", F.col("band") + 1)))
        size = ws.write(member.groupBy("v", "band").agg(F.count("*").alias("all")).join(rest.groupBy("v", "band").agg(F.count("*").alias("others")), ["v", "band"]), "sizes")
        step = 100 / self.percent
        # as many sets a block as keep both its rows and its values bounded
        per_block = F.least(F.lit(BLOCK_ROWS), F.greatest(F.lit(1), F.floor(BLOCK_VALUES / F.pow(F.lit(step), F.col("band") + 2))))
        wide = lambda c: F.ceil(F.col(c) / per_block).cast("int")
        place = lambda n, salt: F.pmod(F.xxhash64("node", F.lit(salt)), n).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        dealt = rest.join(size, ["v", "band"]).select("v", "band", "node", "component", F.lit(True).alias("rest"), place(wide("others"), 0).alias("i"), every(wide("all")).alias("j"))
        dealt = dealt.unionByName(member.join(size, ["v", "band"]).select("v", "band", "node", "component", F.lit(False).alias("rest"), every(wide("others")).alias("i"), place(wide("all"), 1).alias("j")))
        dealt = ws.write(dealt, "dealt")
        sets = self._sets(dealt.select(F.col("node").alias("doc_id")))
        more = dealt.join(sets.hint("merge"), "node").groupBy("v", "band", "i", "j").applyInArrow(_block_links(self.percent), "a long, b long")
        return ws.write(more.distinct(), "more")

    def _verified(self, pairs: DataFrame, name: str) -> DataFrame:
        """Those of the pairs (a, b) that are links: by their sketches first, then by full sets."""
        likely = self._likely(pairs)
        sets = self._sets(likely.select(F.explode(F.array("a", "b")).alias("doc_id")))
        return self.ws.write(self._exact(likely, sets), name)

    def _likely(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) whose sketches allow a link.

        These joins and those of full sets are merge joins at every size, so that a
        table near the broadcast threshold does not change how the job grows.
        """
        x = self.reps.select(F.col("node").alias("a"), F.col("n").alias("nx"), F.col("sketch").alias("x"))
        y = self.reps.select(F.col("node").alias("b"), F.col("n").alias("ny"), F.col("sketch").alias("y"))
        both = pairs.join(x.hint("merge"), "a").join(y.hint("merge"), "b").select("a", "b", "x", "nx", "y", "ny")
        return self.ws.write(both.mapInArrow(_estimate(self.percent / 100), "a long, b long").distinct(), "likely")

    def _sets(self, wanted: DataFrame) -> DataFrame:
        """Full sets (node, members) of the texts of ``wanted`` (doc_id)."""
        wanted = self.ws.write(wanted.distinct(), "wanted")
        sets = about(self.docs, wanted).join(wanted.hint("merge"), "doc_id").mapInArrow(_sets(self.shingle), "node long, members array<long>")
        return self.ws.write(sets.distinct(), "sets")

    def _exact(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        x = sets.select(F.col("node").alias("a"), F.col("members").alias("x"))
        y = sets.select(F.col("node").alias("b"), F.col("members").alias("y"))
        return pairs.join(x.hint("merge"), "a").join(y.hint("merge"), "b").select("a", "b", "x", "y").mapInArrow(_verify(self.percent), "a long, b long").distinct()

    def documents(self) -> DataFrame:
        """doc_id, n_shingles, component_id, kept and the carried columns, one row per row of the input."""
        of = self.classes.select("n", "sig", "sig2", "node").join(self.components, F.col("node") == F.col("id"), "left")
        of = of.select(F.col("n").alias("m"), F.col("sig").alias("s"), F.col("sig2").alias("s2"), F.coalesce("component", "node").alias("c"))
        out = self.prints.join(of, (F.col("n") == F.col("m")) & (F.col("sig") == F.col("s")) & (F.col("sig2") == F.col("s2")), "left")
        cid = F.coalesce("c", "doc_id")
        return out.select("doc_id", F.col("n").alias("n_shingles"), cid.alias("component_id"), F.col("doc_id").eqNullSafe(cid).alias("kept"), *self.carry)


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of all ``documents``, on shingles of four words."""
    return NearDuplicates(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=4).documents()


#: All pairs that share a shingle, for tables of a size that allows them. Texts of equal sets are one class, and classes of one doc_id are linked.
OP7_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' ')) END)) AS s FROM w
), sized AS (
  SELECT doc_id, len(s) AS n, s, CASE WHEN len(s) > 0 THEN md5(array_to_string(s, chr(10))) END AS k FROM s
), class AS (
  SELECT row_number() OVER (ORDER BY k) AS i, * FROM (SELECT k, any_value(n) AS n, any_value(s) AS s, min(doc_id) AS rep FROM sized WHERE n > 0 GROUP BY k HAVING min(doc_id) IS NOT NULL)
), each AS (
  SELECT i, n, unnest(s) AS x FROM class
), pairs AS (
  SELECT p.i AS a, q.i AS b, p.n + q.n - count(*) AS total, count(*) AS shared FROM each p JOIN each q ON p.x = q.x AND p.i < q.i AND 100 * least(p.n, q.n) >= 80 * greatest(p.n, q.n) GROUP BY p.i, q.i, p.n, q.n
), row_of AS (SELECT DISTINCT doc_id, i FROM sized JOIN class USING (k)
), one AS (
  SELECT a, b FROM pairs WHERE 100 * shared >= 80 * total UNION SELECT p.i, q.i FROM row_of p JOIN row_of q ON p.doc_id = q.doc_id AND p.i < q.i
), links AS (SELECT a, b FROM one UNION ALL SELECT b, a FROM one
), reach(a, b) AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), comp AS (SELECT a, min(rep) AS c FROM reach JOIN class ON b = i GROUP BY a)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, coalesce(c, rep, doc_id) AS component_id, doc_id IS NOT DISTINCT FROM coalesce(c, rep, doc_id) AS kept FROM sized LEFT JOIN (SELECT k, rep, i FROM class) r ON r.k = sized.k LEFT JOIN comp ON a = r.i
"""
