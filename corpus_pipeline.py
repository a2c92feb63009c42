"""Corpus pipeline: toxicity, near-dedup, decontamination, pseudonyms, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read back as the next one's docs. All but the last return the
columns of ``documents``; the last returns the same columns with each document
as often as the mix takes it. Extra columns are carried along.

Edge cases: a null or empty text is never toxic, a near duplicate or
contaminated, and has size 0 in the mix; rows that repeat a doc_id or have none
are documents of their own in the near-dedup stage, so of several texts under one
id only the linked ones go, and a row equal in every column to another counts
once; an empty table stays empty; extra columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType, VariantType

from sparkloom.llm.decontam import without_contaminated
from sparkloom.llm.minhash import NearDuplicates
from sparkloom.llm.mixing import mixed
from sparkloom.llm.pii import pseudonymised
from sparkloom.llm.toxicity import trained_on_open, without_toxic
from sparkloom.llm.work import Workspace, columns, free_name

NESTED = (ArrayType, MapType, StructType, VariantType)  # hashed as JSON, since maps have no hash


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the classifier, trained on the labels that are not held out, finds toxic."""
    return without_toxic(spark, docs, trained_on_open(spark, docs, sf_dir))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 or more on shingles of five words.

    A group keeps the row with its smallest doc_id (nulls last). Rows are told apart by a hash of all their columns.
    """
    own = columns(docs)
    plain = [F.to_json(F.struct(c)) if isinstance(docs.schema[n].dataType, NESTED) else c for n, c in zip(docs.columns, own, strict=True)]
    row = F.shiftrightunsigned(F.xxhash64(*plain), 1)
    key = free_name(docs, "__row")
    rows = docs.select(row.alias(key), *own)
    texts = rows.select(F.col(key).alias("doc_id"), "text", F.col("doc_id").alias("__id"))
    found = NearDuplicates(spark, texts, carry=("__id",)).documents()
    first = F.min(F.struct(F.col("__id").isNull().alias("none"), "__id", F.col("doc_id").alias("row")))
    grouped = found.filter("n_shingles > 0").groupBy("component_id").agg(first["row"].alias(key))
    kept = Workspace(spark, "kept").write(grouped.select(key).unionByName(found.filter("n_shingles = 0").select(F.col("doc_id").alias(key))).distinct(), "rows")
    return rows.join(kept, key, "leftsemi").dropDuplicates([key]).select(*own)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, up to the edit budget."""
    return without_contaminated(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pseudonyms in place of personal values; n_chars follows the text."""
    listed = free_name(docs, "__pii_values")
    out = pseudonymised(docs, listed=listed)
    if "n_chars" in docs.columns:
        size = F.char_length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.size(listed) > 0, size).otherwise(F.col("n_chars")))
    return out.select(*columns(docs))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix by source weights."""
    return mixed(spark, docs)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination), ("pii", pii), ("mixing", mixing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, ws = spark.read.parquet(f"{sf_dir}/documents.parquet"), Workspace(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = ws.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
