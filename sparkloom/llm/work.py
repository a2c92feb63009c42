"""Shared working folder for intermediate tables.

Intermediate results are written as tables under ``spark.checkpoint.dir`` (the
folder that the driver and all executors share) and read back, which cuts the
lineage without leaving copies on one machine.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where none is set (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="sparkloom-")
        spark.sparkContext.setCheckpointDir(_OWN[app])
    return "file://" + _OWN[app]


def columns(df: DataFrame) -> list[Column]:
    """All columns of ``df`` by their quoted names, so that dots in a name are no path."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it (whatever the case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Buckets of ids, so many numbers at most are ever broadcast.
BUCKETS = 1 << 20


def _buckets(ids: DataFrame, key: str) -> tuple[Column, DataFrame]:
    bucket = F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(BUCKETS))
    return bucket, F.broadcast(ids.select(bucket.alias("__bucket")).distinct())


def about(rows: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """All rows whose ``key`` is in ``ids`` and few others, without a shuffle.

    Only the buckets that the ids fall into are broadcast, ``BUCKETS`` numbers at
    most; so before texts are shuffled to be joined exactly, most that have no
    partner are left out, and where most have one nothing is lost.
    """
    bucket, some = _buckets(ids, key)
    return rows.join(some, bucket == F.col("__bucket"), "leftsemi")


def not_about(rows: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows that ``about`` leaves out."""
    bucket, some = _buckets(ids, key)
    return rows.join(some, bucket == F.col("__bucket"), "leftanti")


def through(df: DataFrame, column: str, kernel, *more: T.StructField) -> DataFrame:
    """``df.mapInArrow(kernel(name), ...)`` whatever the columns' names; ``name`` is that of ``column`` inside.

    The kernel returns all columns and then ``more``. Inside, columns are numbered,
    since ``mapInArrow`` takes dots in names for paths.
    """
    fields = [T.StructField(f"c{i}", f.dataType) for i, f in enumerate(df.schema.fields)] + [T.StructField(f"c{len(df.columns) + i}", f.dataType) for i, f in enumerate(more)]
    inner = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    out = inner.mapInArrow(kernel(f"c{df.columns.index(column)}"), T.StructType(fields))
    return out.toDF(*df.columns, *(f.name for f in more))


def _delete(jvm, conf, path: str) -> None:
    try:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
    except Exception:  # the gateway may be gone when the interpreter ends
        pass


#: Rows of an Arrow batch: the default of 10,000 is large for rows that are whole texts.
BATCH_ROWS = 2_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches of texts, unless the session has its own setting."""
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, BATCH_ROWS)


class Workspace:
    """A folder of intermediate tables; removed when the interpreter ends, unless it is one to ``keep``."""

    def __init__(self, spark: SparkSession, name: str, keep: str | None = None):
        self.spark, self.keep = spark, keep is not None
        small_batches(spark)
        self.path = keep.rstrip("/") if self.keep else f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self._tables: list[str] = []
        self.places: dict[str, str] = {}
        self._n = 0
        atexit.register(self.close)

    def write(self, df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
        """Write ``df`` as Parquet and return the reader over it."""
        self._n += 1
        path = f"{self.path}/{self._n:02d}-{name}"
        df.write.option("compression", compression).mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def bucketed(self, df: DataFrame, name: str, key: str, buckets: int, dealt: bool = False) -> DataFrame:
        """Write ``df`` hashed and sorted by ``key``, so that joins on it need no shuffle of this side.

        ``dealt``: without a shuffle for the writing either, for few large rows; each task writes its own files.
        """
        self._n += 1
        table = f"sl_{uuid.uuid4().hex[:10]}_{name}"
        self.places[name] = f"{self.path}/{name}-{uuid.uuid4().hex[:10]}" if self.keep else f"{self.path}/{self._n:02d}-{name}"
        (
            (df if dealt else df.repartition(buckets, key))
            .write.option("compression", "zstd")
            .option("path", self.places[name])
            .bucketBy(buckets, key)
            .sortBy(key)
            .format("parquet")
            .saveAsTable(table)
        )
        self._tables.append(table)
        return self.spark.table(table)

    def reopened(self, path: str, schema: str, key: str, buckets: int) -> DataFrame:
        """A table that ``bucketed`` wrote at ``path``, perhaps in another session."""
        table = f"sl_{uuid.uuid4().hex[:10]}"
        self.spark.sql(f"CREATE TABLE {table} ({schema}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{path}'")
        self._tables.append(table)
        return self.spark.table(table)

    def fs(self, path: str):
        """Hadoop's file system of ``path``, and the path as it takes it."""
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def drop(self, df_path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        _delete(jvm, self.spark.sparkContext._jsc.hadoopConfiguration(), df_path)

    def close(self) -> None:
        try:
            for t in self._tables:
                self.spark.sql(f"DROP TABLE IF EXISTS {t}")
            if not self.keep:
                self.drop(self.path)
        except Exception:
            pass
