"""The library travels to where it is not installed."""

import subprocess
import sys

from pyspark.sql import functions as F

from sparkloom.functions.timestamps import parse_ts
from sparkloom.session import packed


def test_packed_library_can_be_imported(tmp_path):
    path = packed(str(tmp_path))
    code = f"import sys; sys.path[:0] = [{path!r}]; import sparkloom.operators.memory as m, sparkloom.plans.catalogue; print(m.__file__)"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=tmp_path, check=True).stdout
    assert path in out


def test_iso_weeks(spark):
    from datetime import datetime

    texts = ["2026-W01", "2026-W53-7", "2025-W53-1", "2020-W53-5T10:20", "2020W535", "2020W53", "2026-W00-1", "2026-W10-8", "2026-W10-0", "2026-W105", "2026W10-5", "2021-W01-1T00:00:00+02:00", "0001-W01-1", "W10", "2026-W1"]
    got = {r.t: r.us for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.unix_micros(parse_ts("t")).alias("us")).collect()}
    for t in texts:
        try:
            d = datetime.fromisoformat(t)
            want = int((d.replace(tzinfo=None) - datetime(1970, 1, 1)).total_seconds() - (d.utcoffset().total_seconds() if d.utcoffset() else 0)) * 1_000_000
        except ValueError:
            want = None
        assert got[t] == want, t
