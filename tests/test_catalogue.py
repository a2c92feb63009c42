"""Every query of the library against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from sparkloom.plans import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    got, cols = df.collect(), sorted(df.columns)
    if name not in catalogue.oracle_sql():
        assert got
        return
    r = duck.execute(catalogue.oracle_sql()[name])
    at = [d[0] for d in r.description]
    assert sorted(at) == cols
    want = r.fetchall()
    key = lambda rows: sorted((tuple(map(plain, x)) for x in rows), key=repr)
    assert key([x[c] for c in cols] for x in got) == key([x[at.index(c)] for c in cols] for x in want)


def test_entry_module(spark):
    import __spark_entry__ as e

    assert set(catalogue.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    if os.path.isdir("/root/testdata/sf0.001"):
        assert e.entry(spark).count() > 0


def test_scoped_reads_prune(spark, tmp_path):
    from sparkloom.operators.memory import MemoryStore

    store = MemoryStore(spark, str(tmp_path / "m"), parts=8)
    store.add(spark.createDataFrame([(i, f"p{i}", "o", "raw", "x", 1.0, "2026-01-01", None) for i in range(20)], "seq long, profile_id string, owner string, layer string, content string, importance double, ts string, meta string"))
    plan = store.state("p3", "o")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan and "PushedFilters" in plan
    assert store.state("p3", "o").count() == 1


def test_stream_sessions(spark, tmp_path):
    from sparkloom.streaming.sessions import stream_sessions

    rows = [("a", "2026-01-01 00:00:00"), ("a", "2026-01-01 05:00:00"), ("a", "2026-01-02 00:00:00"), ("b", None), ("b", "2026-01-01 00:00:00"), ("z", "2026-01-05 00:00:00")]
    spark.createDataFrame(rows, "k string, ts string").write.json(str(tmp_path / "in"))
    s = stream_sessions(spark.readStream.schema("k string, ts string").json(str(tmp_path / "in")), "k")
    q = s.writeStream.outputMode("append").format("memory").queryName("sessions").start()
    try:
        q.processAllAvailable()
        assert sorted((r.k, r.n_messages) for r in spark.table("sessions").collect()) == [("a", 1), ("a", 2), ("b", 1)]
    finally:
        q.stop()
