"""What Python makes of a batch is made in parts of bounded size."""

import pyarrow as pa
from pyspark.sql import functions as F

from sparkloom.functions import batches, timestamps
from sparkloom.operators import chunking, evidence, extract, merge


def test_parts():
    b = pa.RecordBatch.from_pydict({"t": pa.array(["aa", None, "b", "éé", "long one", "", "z"], pa.string()), "i": list(range(7))})
    got = [p.column("i").to_pylist() for p in batches.parts(b, "t", 4)]
    assert got == [[0, 1, 2], [3], [4], [5, 6]]
    assert list(batches.parts(b.slice(0, 0), "t", 4)) == []
    assert [p.column("i").to_pylist() for p in batches.parts(b.slice(3, 2), "t", 4)] == [[3], [4]]


def test_rows_go_through_python_in_parts(spark):
    """A frame's batch of many texts leaves the three kernels in several; their answers are those of single texts."""
    assert all(f.__globals__["parts"] is batches.parts for f in (chunking.chunk_novels, evidence.contained, extract.call_blocks))
    books = spark.range(30, numPartitions=1).selectExpr("id", "concat(id, ' ', repeat('ab cd. ', 20000)) AS text")
    got = chunking.chunk_novels(books, "id", chunk_chars=200_000)
    assert [tuple(r) for r in got.selectExpr("id", "length(content)").orderBy("id", "block_id", "idx").collect()] == [(i, len(f"{i} " + "ab cd. " * 20000) - 1) for i in range(30)]
    found = evidence.contained(books.selectExpr("id AS at", "text AS t"), spark.createDataFrame([(1, "29 ab"), (2, "cd. ab")], "b int, q string"))
    assert sorted(map(tuple, found.collect())) == sorted([(i, 2) for i in range(30)] + [(29, 1)])


def test_rare_times_match_their_pattern_once(spark):
    plan = spark.range(1).select(timestamps.parse_ts(F.col("id").cast("string")))._jdf.queryExecution().analyzed().toString()
    assert 2 <= plan.count("[.,]") <= 12  # a group at a time it was far more
    told = [("20240102T0304", 1704164640), ("2024-01-02T03:04:05,5-0130", 1704170045), ("2024-01-02T03:04:05.123456789+01:00:01", 1704161044), ("20240102 030405Z", 1704164645), ("2024-01-02T3", None), ("20241302T00", None)]
    got = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(told)], "i int, s string").select("i", timestamps.parse_ts("s").alias("t")).selectExpr("i", "unix_seconds(t) AS n").orderBy("i").collect()
    assert [r.n for r in got] == [n for _, n in told]


def test_notes_carry_no_texts(spark):
    rows = [("a", 1, 0, "T", "one"), ("a", 1, 1, "t!", "two"), ("a", 2, 0, "T", "ONE."), ("b", 1, 0, "", "only text")]
    lore = spark.createDataFrame(rows, "source string, block_id int, pos int, title string, content string").selectExpr("*", "content AS keys")
    first, notes = merge.merge_lore(lore, ["source"])
    assert [tuple(r)[:3] for r in notes.collect()] == [("a", 1, 1)]
    assert sorted((r.source, r.content) for r in first.collect()) == [("a", "one"), ("b", "only text")]
    join = next(line for line in notes._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Aggregate" in line)
    assert "content" not in join
