"""One conversation, one book, many queries: the forms that deal a hot group out equal the plain ones."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkloom.operators.chunking import chunk_hot_messages, chunk_messages, chunk_novel_lines, chunk_novels, numbered
from sparkloom.operators.similarity import Best, jaccard_pairs, jaccard_top

MESSAGES = "c string, ts string, ord long, content string"


def conversation(rng, n, who):
    rows, t = [], 1_700_000_000
    for i in range(n):
        t += rng.choice([0, 60, 600, 3000, 30_000, -500])
        ts = str(t) if rng.random() < 0.8 else f"soon {rng.randrange(9)}"
        rows.append((who, ts, i, f"m{i}"))
    return rows


@pytest.mark.parametrize("ranges, size", [(1, 3), (9, 4), (40, 7), (40, 1)])
def test_hot_conversation(spark, rows, ranges, size):
    rng = random.Random(ranges + size)
    told = conversation(rng, 260, "hot") + conversation(rng, 20, "a") + conversation(rng, 3, None) + conversation(rng, 1, "z")
    m = spark.createDataFrame(told, MESSAGES)
    cols = ("c", "ts", "ord", "content", "block_id", "idx")
    want = rows(chunk_messages(m, ["c"], size, 6.0), *cols)
    got = chunk_hot_messages(m, ["c"], size, 6.0, ranges=ranges)
    assert got.columns == [*m.columns, "block_id", "idx"] and rows(got, *cols) == want
    alone = chunk_hot_messages(m.filter("c = 'hot'").drop("c"), [], size, 0.1, ranges=ranges)
    assert rows(alone, *cols[1:]) == rows(chunk_messages(m.filter("c = 'hot'").withColumn("c", F.lit(1)), ["c"], size, 0.1), *cols[1:])


def test_hot_conversation_without_gaps_or_times(spark, rows):
    for ts in ("2026-01-01", "no time"):
        m = spark.createDataFrame([("x", ts, i, "") for i in range(101)], MESSAGES)
        assert rows(chunk_hot_messages(m, ["c"], 10, ranges=13), "ord", "block_id", "idx") == sorted(((i, i // 10, i % 10) for i in range(101)), key=repr)
    assert chunk_hot_messages(m.limit(0), ["c"]).collect() == []
    with pytest.raises(ValueError):
        chunk_hot_messages(m, ["c"], 0)


def test_a_hot_conversation_lies_in_many_ranges(spark):
    seen = []

    def cut(df, name):
        out = spark.createDataFrame(df.toPandas(), df.schema)
        seen.append(out.groupBy("__range").count().collect())
        return out

    m = spark.range(20_000).select(F.lit("x").alias("c"), F.lpad(F.col("id").cast("string"), 12, "0").alias("ts"), F.col("id").alias("ord"), F.lit("").alias("content"))
    chunk_hot_messages(m, ["c"], ranges=8, cut=cut)
    assert len(seen[0]) == 8 and max(r["count"] for r in seen[0]) < 2 * 20_000 / 8


def book(rng, n):
    line = lambda: rng.choice(["", "  ", "Chapter 3 on", "第三章 海", "尾声", "a line. " * rng.randrange(1, 30), "很长的一句话！" * rng.randrange(1, 150), "x" * rng.randrange(1, 900)])
    return "\n".join(line() for _ in range(n))


@pytest.mark.parametrize("ranges", [1, 6, 30])
def test_long_books(spark, rows, ranges):
    rng = random.Random(ranges)
    books = [("a", book(rng, 200)), ("b", book(rng, 3)), ("c", ""), ("d", "Chapter 1\n" * 30), ("e", "no heading at all. " * 200)]
    whole = spark.createDataFrame(books, "k string, text string")
    lines = spark.createDataFrame([(k, i, x) for k, t in books for i, x in enumerate(t.split("\n"))] + [(None, 0, "of no book")], "k string, line int, text string")
    cols = ("k", "block_id", "idx", "ts", "content")
    for chars in (200, 3000):
        assert rows(chunk_novel_lines(lines, "k", chunk_chars=chars, ranges=ranges), *cols) == rows(chunk_novels(whole, "k", chunk_chars=chars), *cols)
    # rows that hold several lines count as these
    parts = spark.createDataFrame([(k, i, "\n".join(t.split("\n")[i * 7 : i * 7 + 7])) for k, t in books for i in range(40)], "k string, line int, text string")
    assert rows(chunk_novel_lines(parts, "k", ranges=ranges), *cols) == rows(chunk_novels(whole, "k"), *cols)
    assert chunk_novel_lines(lines.limit(0), "k").collect() == []
    with pytest.raises(ValueError):
        chunk_novel_lines(lines, "k", chunk_chars=100)


@pytest.mark.parametrize("ranges", [1, 11])
def test_numbers_across_ranges(spark, ranges):
    rng = random.Random(ranges)
    told = [(rng.choice(["a", "b", None]), rng.choice([None, *range(40)]), i) for i in range(300)]
    df = spark.createDataFrame(told, "k string, t int, i long")
    got = sorted(map(tuple, numbered(df, ["k"], ["t", "i"], "place", ranges=ranges).collect()), key=repr)
    want = [(*r, n) for k in ("a", "b", None) for n, r in enumerate(sorted((r for r in told if r[0] == k), key=lambda r: (r[1] is not None, r[1] or 0, r[2])))]
    assert got == sorted(want, key=repr)
    assert sorted(r.n for r in numbered(df.drop("k"), [], [-F.col("i")], "n", ranges=ranges).collect()) == list(range(300))


def texts(rng, n, letters="abcdefgh"):
    return ["".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 2, 5, 20, 60]))) for _ in range(n)]


@pytest.mark.parametrize("k, limit", [(1, 1 << 20), (4, 150), (60, 1 << 20)])
def test_top_of_each_query(spark, monkeypatch, k, limit):
    from sparkloom.operators import similarity

    monkeypatch.setattr(similarity, "PAIRS", 64)
    rng = random.Random(k)
    t = spark.createDataFrame([(i // 3, i % 3, x) for i, x in enumerate(texts(rng, 120))] + [(None, 0, "abcd"), (7, None, "abcd"), (99, 0, None)], "c long, n int, text string").repartition(3)
    q = spark.createDataFrame([*enumerate(texts(rng, 14)), (50, "abcd"), (51, None), (52, "zz"), (None, "abcd")], "q long, text string")
    pairs = [r for r in jaccard_pairs(t, q, "q").collect() if r.jaccard > 0]
    want = []
    for query in {r.q for r in pairs}:
        best = sorted((r for r in pairs if r.q == query), key=lambda r: (-r.jaccard, r.c is None, r.c, r.n is None, r.n))[:k]
        want += [(query, i + 1, r.c, r.n, r.jaccard) for i, r in enumerate(best)]
    got = jaccard_top(t, q, "q", k, limit)
    assert got.columns == ["q", "rank", "c", "n", "jaccard"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert jaccard_top(t.limit(0), q, "q", k).collect() == [] and jaccard_top(t, q.limit(0), "q", k).collect() == []
    with pytest.raises(ValueError):
        jaccard_top(t, q, "q", 0)


def test_lists_of_common_pairs_are_not_read():
    """Once near texts are known, those that can only share common pairs are not looked up in the long lists."""
    rng = random.Random(1)
    common = [f"c{i}" for i in range(20)]
    queries = [[*common, *(f"r{q}-{i}" for i in range(20))] for q in range(50)]
    best = Best(queries, 1)
    best.add(pa.array([list(q) for q in queries]), [(i,) for i in range(50)])
    assert best.floor.tolist() == [1.0] * 50
    before = best.read
    others = [[*common, *(f"x{rng.random()}" for _ in range(20))] for _ in range(500)]
    best.add(pa.array(others), [(100 + i,) for i in range(500)])
    assert best.read == before and [b[0][1] for b in best.kept] == [(i,) for i in range(50)]
    near = [[*common, *(f"r{q}-{i}" for i in range(19)), f"r{(q + 1) % 50}-0"] for q in range(50)]
    best = Best(queries, 1)
    best.add(pa.array(near), [(i,) for i in range(50)])
    start = best.read
    best.add(pa.array(near), [(i,) for i in range(50)])
    assert best.read - start < start / 2 and best.kept[3] == [(39 / 41, (3,))]


def test_best_texts_count_candidates_in_bounded_runs(monkeypatch):
    """What is in memory of lists and candidates is bounded, whatever a batch has, and the result is the same."""
    from sparkloom.operators import similarity

    texts = pa.array([[f"{(i * j) % 23}x" for j in range(1, 15)] for i in range(200)], pa.list_(pa.string()))
    texts = pa.array([sorted(set(t)) for t in texts.to_pylist()], pa.list_(pa.string()))
    queries, keys = [sorted({f"{(7 * i + j) % 23}x" for j in range(9)}) for i in range(12)], [(i,) for i in range(200)]

    def best(limit):
        monkeypatch.setattr(similarity, "ENTRIES", limit)
        made, repeat = [], np.repeat
        monkeypatch.setattr(similarity.np, "repeat", lambda *a, **k: made.append(repeat(*a, **k)) or made[-1])
        b = similarity.Best(queries, 3)
        b.add(texts, keys)
        monkeypatch.setattr(similarity.np, "repeat", repeat)
        return b.kept, max(len(x) for x in made)

    want = [sorted(((len(set(t) & set(q)) / len(set(t) | set(q)), (i,)) for i, t in enumerate(texts.to_pylist())), key=lambda x: (-x[0], x[1]))[:3] for q in queries]
    (small, most), (large, _) = best(50), best(1 << 20)
    assert small == large == want
    assert most <= max(50, sum(len(t) for t in texts.to_pylist()))
