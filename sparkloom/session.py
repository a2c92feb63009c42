"""Session settings the library relies on."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: UTC makes timestamps comparable; speculation would issue paid extraction calls twice.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.speculation": "false",
    "spark.ui.enabled": "false",
}


def session(name: str = "sparkloom", master: str | None = None, **more: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in (SETTINGS | more).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    return spark if spark.sparkContext.master.startswith("local") else ship(spark)


def packed(folder: str | None = None) -> str:
    """The library as a zip file that Python imports from."""
    home = Path(__file__).resolve().parent
    out = Path(folder or tempfile.mkdtemp(prefix="sparkloom-")) / "sparkloom.zip"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(home.rglob("*.py")):
            z.write(f, f.relative_to(home.parent))
    return str(out)


def ship(spark: SparkSession) -> SparkSession:
    """Sends the library to the executors, whose Python workers import it; needed where it is not installed there."""
    spark.sparkContext.addPyFile(packed())
    return spark
