"""Mixing sources to target weights, with DataFrame functions only.

Sizes are added up per source (partial sums before the shuffle), each source
gets a target by weight that stops at ``max_repeat`` times its size, and each
document is emitted floor(rate) times plus one more with probability equal to
the fraction, decided by a hash of seed and doc_id. Equal doc_ids decide alike,
so reruns agree.

Edge cases: a null text has size 0; a null source is a source of its own, last
in order; a null doc_id hashes as the empty string; repeated rows each count;
an empty table gives an empty result; whole texts count, however long; other columns
are passed through unread, whatever their names (those of ``copies``' own columns
take underscores until they are free in ``mixed``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .work import Workspace, columns

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_repeat: int = 3) -> DataFrame:
    """Targets of each source from rows (source, size).

    Sources in code-point order, null last, take ``weights`` in turn. A source
    whose share exceeds its limit gets the limit; what is left is shared by
    weight among the others. Ordered by limit / weight, a source is at its limit
    exactly if the share of those from it onwards exceeds it, so one pass over
    the sources (not the documents) settles all.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # one row per source, so these windows see a table of sources, never documents
    order = W.orderBy(F.col("source").asc_nulls_last())
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("w", weight.cast("long")).withColumn("cap", F.col("source_size").cast("decimal(38,0)") * max_repeat)
    before = W.orderBy(F.col("cap").cast("double") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    per = (
        per.withColumn("total", F.sum("source_size").over(every))
        .withColumn("all_w", F.sum("w").over(every))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("w_before", F.coalesce(F.sum("w").over(before), F.lit(0)))
        .withColumn("full", F.col("cap") * (F.col("all_w") - F.col("w_before")) < F.col("w") * (F.col("total") - F.col("cap_before")))
        .withColumn("given", F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(every), F.lit(0)))
        .withColumn("open_w", F.coalesce(F.sum(F.when(~F.col("full"), F.col("w"))).over(every), F.lit(1)))
    )
    share = ((F.col("total") - F.col("given")) * F.col("w")).cast("double") / F.col("open_w").cast("double")
    return per.select("source", "source_size", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def uniform(seed: int, doc_id: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of md5(seed:doc_id)."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def copies(spark: SparkSession, docs: DataFrame, weights=(5, 2, 1), max_repeat: int = 3, seed: int = 17, size: Column | None = None, prefix: str = "__mix_") -> DataFrame:
    """``docs`` with __mix_size, __mix_source_size, __mix_target and __mix_copies.

    The table of targets is written, so Spark knows its size and broadcasts it below
    the session's threshold; beyond, it splits the hot sources of the join.
    """
    name = lambda c: prefix + c
    docs = docs.withColumn(name("size"), word_count(F.col("text")) if size is None else size)
    per = source_targets(docs.select("source", F.col(name("size")).alias("size")), weights, max_repeat)
    per = Workspace(spark, "mixing").write(per, "targets")
    per = per.select(_key(F.col("source")).alias(name("key")), F.col("source_size").alias(name("source_size")), F.col("target").alias(name("target")))
    rate = F.when(F.col(name("source_size")) > 0, F.col(name("target")) / F.col(name("source_size"))).otherwise(F.lit(0.0))
    out = docs.withColumn(name("key"), _key(F.col("source"))).join(per, name("key")).drop(name("key"))
    more = (uniform(seed, F.col("doc_id")) < rate - F.floor(rate)).cast("long")
    return out.withColumn(name("copies"), F.floor(rate) + more)


def mixed(spark: SparkSession, docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, columns unchanged."""
    prefix = "__mix_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    out = copies(spark, docs, prefix=prefix, **how).filter(F.col(prefix + "copies") > 0)
    out = out.withColumn(prefix + "copy", F.explode(F.sequence(F.lit(1), F.col(prefix + "copies"))))
    return out.select(*columns(docs))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken of all ``documents``, weights 5, 2, 1 and three repeats at most."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    out = copies(spark, docs)
    return out.select(
        "doc_id",
        F.col("__mix_size").alias("size"),
        F.col("__mix_source_size").alias("source_size"),
        F.col("__mix_target").alias("target"),
        (F.col("__mix_copies") * F.col("__mix_size")).alias("taken"),
    )


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(sum(size) * 3 AS BIGINT) AS cap FROM d GROUP BY source
), w AS (
  SELECT *, CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS BIGINT) AS w FROM s
), a AS (
  SELECT *, sum(source_size) OVER () AS total, sum(w) OVER () AS all_w,
    coalesce(sum(cap) OVER b, 0) AS cap_before, coalesce(sum(w) OVER b, 0) AS w_before
  FROM w WINDOW b AS (ORDER BY CAST(cap AS DOUBLE) / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f AS (SELECT *, cap * (all_w - w_before) < w * (total - cap_before) AS is_full FROM a
), t AS (
  SELECT source, source_size, CASE WHEN is_full THEN CAST(cap AS DOUBLE)
    ELSE CAST((total - coalesce(sum(CASE WHEN is_full THEN cap END) OVER (), 0)) * w AS DOUBLE)
       / CAST(coalesce(sum(CASE WHEN NOT is_full THEN w END) OVER (), 1) AS DOUBLE) END AS target
  FROM f
), r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
    CAST(CAST('0x' || substr(md5('17:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  CAST((floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM r
"""
