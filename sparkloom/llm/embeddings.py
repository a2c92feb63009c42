"""Embedding near-duplicates by randomised-rotation binary codes.

Every distinct vector is rotated by a random orthogonal matrix and kept as one
sign bit a dimension with a correction factor <code, vector>. Code and factor
give an unbiased estimate of an inner product and a bound on its error; only
pairs whose upper bound reaches the threshold are computed exactly. Pairs are
looked for within buckets of further random projections: ``tables`` tables of
``bits`` bits, chosen so that a pair at the threshold shares a bucket with
probability ``recall``. A bucket of over ``BLOCK`` vectors is dealt out as pairs
of blocks, so no task holds more than two blocks, and nothing is capped. With a
``recall`` of 1 there is one bucket a label, every pair of blocks is compared, and no
bound leaves a pair out: the exact way, whose work grows with the square of a label.

Vectors keep their type; each is scaled by its largest component before its length
is taken, so very small and very large doubles neither vanish nor overflow. Vectors
travel with their codes, since the links of a block are counted where they are found:
a group of near copies would make the square of its size in pairs to be fetched for.

Edge cases: vectors that are null, zero or hold null or non-finite components,
and those with a null label, link with nothing; only equal labels and equal
lengths are compared; equal vectors are one class and link with each other;
repeated rows count as copies; an empty table gives no rows; columns other than the
three are not read, whatever their names; a row with a null id can link (it has no class
id of its own, so a component of nulls alone has a null id and its rows are kept); different
vectors under one id are vectors of their own, which the id does not link.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import components
from .work import Workspace

BLOCK = 768
EPSILON = 4.0  # width of the confidence bound, in standard errors


def rotation(dim: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def planes(dim: int, n: int, seed: int) -> np.ndarray:
    return np.concatenate([rotation(dim, seed + 1 + k) for k in range(max(1, -(-n // dim)))])[:n]


def plan(largest: int, threshold: float, recall: float) -> tuple[int, int]:
    """Bits per table and number of tables for groups of up to ``largest`` vectors; none and one for an exact search."""
    bits = max(0, math.ceil(math.log2(max(1, largest) / BLOCK)))
    if bits == 0 or recall >= 1:
        return 0, 1
    share = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - share)))


def units(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double precision."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _encode(bits: int, tables: int, seed: int, kind: str):
    def encode(batches):
        for b in batches:
            for dim in np.unique(np.asarray(b.column("dim"))).tolist():
                part = b.filter(pa.compute.equal(b.column("dim"), dim))
                x = np.asarray(part.column("embedding").flatten(), dtype=np.float64).reshape(-1, dim)
                unit = units(x)
                turned = unit @ rotation(dim, seed).T
                factor = np.abs(turned).sum(axis=1) / math.sqrt(dim)
                code = np.packbits(turned > 0, axis=1)
                sides = (unit @ planes(dim, bits * tables, seed).T > 0).reshape(len(x), tables, bits)
                keys = (sides * (1 << np.arange(bits, dtype=np.int64))).sum(axis=2, dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("label"), part.column("dim"), part.column("node"), part.column("copies"), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(factor), pa.array([v.tobytes() for v in x.astype(kind)], pa.binary()), pa.array(list(keys), pa.list_(pa.int64()))],
                    names=["label", "dim", "node", "copies", "code", "factor", "vector", "keys"],
                )

    return encode


def pair_links(vectors: np.ndarray, codes: np.ndarray, factors: np.ndarray, rotated: np.ndarray, left: slice, right: slice, threshold: float, exact: bool = False) -> np.ndarray:
    """Which pairs left x right have a cosine of at least ``threshold``.

    The estimate of <o, q> from o's code is <code(o), q> / <code(o), o>; its
    standard error is sqrt((1 - f^2) / f^2 / (dim - 1)) for f = <code(o), o>.
    ``exact`` computes all pairs instead (a product of matrices differs from the
    sums that decide in the last digits only).
    """
    dim = vectors.shape[1]
    if exact:
        guess, error = vectors[left] @ vectors[right].T, 1e-9
    else:
        f = factors[left][:, None]
        guess = (codes[left] / math.sqrt(dim) @ rotated[right].T) / f
        error = EPSILON * np.sqrt(np.maximum(0, 1 - f * f) / (f * f) / max(1, dim - 1))
    i, j = np.nonzero(guess + error >= threshold)
    out = np.zeros(guess.shape, dtype=bool)
    a, b = vectors[left], vectors[right]
    for lo in range(0, len(i), 65536):
        p, q = i[lo : lo + 65536], j[lo : lo + 65536]
        out[p, q] = np.einsum("ij,ij->i", a[p], b[q]) >= threshold
    return out


def _compare(threshold: float, seed: int, kind: str, exact: bool):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])

    def compare(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        _, dim, t, _, lo, hi = (k.as_py() for k in key)
        table = table.sort_by([("block", "ascending"), ("node", "ascending")])
        node = np.asarray(table.column("node"))
        x = units(np.frombuffer(b"".join(table.column("vector").to_pylist()), dtype=kind).reshape(-1, dim).astype(np.float64))
        bits = np.unpackbits(np.frombuffer(b"".join(table.column("code").to_pylist()), dtype=np.uint8).reshape(len(x), -1), axis=1)[:, :dim]
        rotated, signs = x @ rotation(dim, seed).T, bits * 2.0 - 1.0
        keys = np.array(table.column("keys").to_pylist(), dtype=np.int64)
        cut = int(np.searchsorted(np.asarray(table.column("block")), lo, side="right"))
        left, right = (slice(0, cut), slice(cut, len(x))) if lo != hi else (slice(0, len(x)), slice(0, len(x)))
        hit = pair_links(x, signs, np.asarray(table.column("factor")), rotated, left, right, threshold, exact)
        for u in range(t):  # a pair counts in the first table that has it in one bucket
            hit &= keys[left, u][:, None] != keys[right, u][None, :]
        if lo == hi:  # the two estimates of a pair differ: take either
            hit |= hit.T
            np.fill_diagonal(hit, False)
        copies = np.asarray(table.column("copies"))
        degree = np.zeros(len(x), dtype=np.int64)
        degree[left] += hit @ copies[right]
        if lo != hi:
            degree[right] += hit.T @ copies[left]
        full = np.zeros((len(x), len(x)), dtype=bool)
        full[left, right] = hit
        full |= full.T
        root, before = np.arange(len(x)), None
        while before is None or (root != before).any():
            before = root
            root = np.minimum(root, np.where(full, root[None, :], len(x)).min(axis=1, initial=len(x)))
        some, other = np.flatnonzero(degree), np.flatnonzero(root != np.arange(len(x)))
        none = pa.nulls(len(some), pa.int64())
        return pa.concat_tables(
            [
                pa.Table.from_arrays([pa.array(node[some]), none, pa.array(degree[some])], schema=schema),
                pa.Table.from_arrays([pa.array(node[other]), pa.array(node[root[other]]), pa.nulls(len(other), pa.int64())], schema=schema),
            ]
        )

    return compare


def near_duplicates(spark: SparkSession, vectors: DataFrame, threshold: float = 0.93, recall: float = 0.999, seed: int = 11) -> DataFrame:
    """vec_id, n_links, component_id, kept for ``vectors`` (vec_id, embedding, label)."""
    ws = Workspace(spark, "embeddings")
    e = F.col("embedding")
    single = vectors.schema["embedding"].dataType.elementType.simpleString() == "float"
    part_kind = "<f4" if single else "<f8"
    numbers = F.transform(e, lambda x: x.cast("float" if single else "double"))
    usable = F.col("label").isNotNull() & F.coalesce(F.size(e) > 0, F.lit(False)) & F.coalesce(F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False)) & F.coalesce(F.exists(e, lambda x: x != 0), F.lit(False))
    rows = vectors.select("vec_id", "label", F.when(usable, numbers).alias("embedding"))
    classes = rows.filter("embedding IS NOT NULL").groupBy("label", "embedding").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("copies"))
    # a number of its own for each class, since ids may be null or repeated
    classes = ws.write(classes.withColumn("node", F.monotonically_increasing_id()).withColumn("dim", F.size("embedding")), "classes")
    largest = classes.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 0
    bits, tables = plan(largest, threshold, recall)
    kind = vectors.schema["label"].dataType.simpleString()
    coded = classes.select("label", "dim", "node", "copies", "embedding").mapInArrow(_encode(bits, tables, seed, part_kind), f"label {kind}, dim int, node long, copies long, code binary, factor double, vector binary, keys array<long>")
    placed = ws.write(coded, "codes").select("*", F.posexplode("keys").alias("t", "key"))
    # the vectors of a bucket beyond BLOCK are dealt into blocks, and each pair of blocks is one group
    count = placed.groupBy("label", "dim", "t", "key").count()
    blocks = F.ceil(F.col("count") / BLOCK).cast("int")
    placed = placed.join(count, ["label", "dim", "t", "key"]).withColumn("blocks", blocks).drop("count").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))
    found = dealt.groupBy("label", "dim", "t", "key", "lo", "hi").applyInArrow(_compare(threshold, seed, part_kind, recall >= 1), "a long, b long, n long")
    found = ws.write(found, "found")
    degree = found.filter("b IS NULL").groupBy("a").agg(F.sum("n").alias("n"))
    comp = components(ws, found.filter("b IS NOT NULL").select("a", "b"))
    comp = comp.withColumnRenamed("id", "node").join(classes.select("node", "first_id"), "node")
    comp = comp.join(comp.groupBy("component").agg(F.min("first_id").alias("smallest")), "component").select("node", "smallest")
    of = classes.join(degree.withColumnRenamed("a", "node"), "node", "left").join(comp, "node", "left")
    of = of.select(F.col("label").alias("l"), F.col("embedding").alias("e"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("smallest", "first_id").alias("c"))
    out = rows.join(of, (F.col("label") == F.col("l")) & (F.col("embedding") == F.col("e")), "left")
    cid = F.coalesce("c", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), cid.alias("component_id"), F.col("vec_id").eqNullSafe(cid).alias("kept"))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept of all ``embeddings``, by a cosine of 0.93 or more within a label."""
    return near_duplicates(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))


OP10_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e, row_number() OVER () AS r FROM embeddings
), good AS (
  SELECT r, label, e FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT p.r AS a, q.r AS b FROM good p JOIN good q ON p.label = q.label AND p.r <> q.r AND len(p.e) = len(q.e) WHERE list_cosine_similarity(p.e, q.e) >= 0.93
), reach(a, b) AS (
  SELECT a, b FROM links UNION SELECT x.a, l.b FROM reach x JOIN links l ON x.b = l.a
), comp AS (SELECT a, min(vec_id) AS c FROM reach JOIN v ON b = r GROUP BY a
), n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(least(c, vec_id), c, vec_id) AS component_id, vec_id IS NOT DISTINCT FROM coalesce(least(c, vec_id), c, vec_id) AS kept FROM v LEFT JOIN comp ON comp.a = r LEFT JOIN n ON n.a = r
"""
