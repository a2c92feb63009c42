import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sparkloom.functions.timestamps import days_between, parse_ts
from sparkloom.operators import chunking as c


def frame(spark, ts, scope=None):
    return spark.createDataFrame([(scope[i] if scope else 0, i, t, f"m{i}") for i, t in enumerate(ts)], "scope int, ord long, ts string, content string")


def iso(minutes):
    return (datetime(2026, 1, 1) + timedelta(minutes=minutes)).isoformat()


def sizes(df):
    return [r["count"] for r in df.groupBy("block_id").count().orderBy("block_id").collect()]


def test_sizes_and_gaps(spark):
    assert sizes(c.chunk_messages(frame(spark, [iso(i) for i in range(250)]), ["scope"])) == [100, 100, 50]
    assert sizes(c.chunk_messages(frame(spark, [iso(x) for x in (0, 1, 2, 363, 364)]), ["scope"])) == [3, 2]
    assert sizes(c.chunk_messages(frame(spark, [iso(x) for x in (0, 360)]), ["scope"])) == [2]  # six hours are no gap
    assert sizes(c.chunk_messages(frame(spark, [iso(0)]), ["scope"])) == [1]
    assert c.chunk_messages(frame(spark, [iso(0)]).limit(0), ["scope"]).count() == 0
    with pytest.raises(ValueError):
        c.chunk_messages(frame(spark, [iso(0)]), ["scope"], block_size=0)


def sequential(ts, size, hours):
    def when(t):
        try:
            return datetime.fromisoformat(t)
        except ValueError:
            return None

    out, n, block, last = {}, 0, 0, None
    for i in sorted(range(len(ts)), key=lambda i: (ts[i], i)):
        t = when(ts[i])
        if n and (n >= size or (last and t and t - last > timedelta(hours=hours))):
            block, n = block + 1, 0
        out[i] = (block, n)
        n, last = n + 1, t or last
    return out


def test_against_a_sequential_pass(spark):
    rng = random.Random(7)
    ts, scope, want = [], [], {}
    for s in range(40):
        own = [rng.choice([iso(rng.randrange(4000)), iso(rng.randrange(4000)), f"2026-01-0{rng.randrange(1, 4)}x{rng.random():.3f}", "none"]) for _ in range(rng.randrange(1, 25))]
        base = len(ts)
        want |= {base + i: v for i, v in sequential(own, 4, 6).items()}
        ts += own
        scope += [s] * len(own)
    got = c.chunk_messages(frame(spark, ts, scope), ["scope"], 4, 6).select("ord", "block_id", "idx").collect()
    assert {r.ord: (r.block_id, r.idx) for r in got} == want


def test_parse_ts(spark):
    cases = {"0": 0, " 60 ": 60, "2026-01-01": 1767225600, "2026-01-01T00:00:00Z": 1767225600, "2026-01-01 01:00:00+01:00": 1767225600, "2026": 2026, "2026-01": None, "10:00": None, "1767225600000": None, "": None, "x": None, "2026-02-30": None}
    df = spark.createDataFrame([(k,) for k in cases], "s string").select("s", (F.unix_micros(parse_ts("s")) / 1_000_000).alias("t"))
    assert {r.s: r.t for r in df.collect()} == cases
    days = spark.range(1).select(days_between(F.lit("2026-01-03"), F.lit("2026-01-01")).alias("a"), days_between(F.lit("2026-01-01"), F.lit("2026-01-03")).alias("b"), days_between(F.lit("2026-01-01"), F.lit("?")).alias("c")).first()
    assert tuple(days) == (2.0, 0.0, 0.0)


def greedy(parts, limit):
    out, buf = [], ""
    for p in parts:
        if buf and len(buf) + len(p) > limit:
            out.append(buf)
            buf = p
        else:
            buf += p
    return out + [buf] * bool(buf)


def test_split_long():
    import re

    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice("ab。！?…") if rng.random() < 0.3 else "x" * rng.randrange(1, 30) for _ in range(rng.randrange(1, 40)))
        want = [text] if len(text) <= 50 else greedy(re.split(r"(?<=[。！？!?…])", text), 50)
        assert c.split_long(text, 50) == want


def test_novel_blocks(spark):
    text = "Chapter 1 x\n" + "a" * 150 + "\n" + "b" * 150 + "\n\n第二章 y\nshort\n" + "c" * 700
    got = c.chunk_novels(spark.createDataFrame([(1, text), (2, None), (3, " \n")], "doc_id long, text string"), "doc_id", chunk_chars=200).orderBy("block_id", "idx").collect()
    assert [(r.block_id, r.idx, r.content[:3], len(r.content), r.ts) for r in got] == [
        (0, 0, "Cha", 11, "1000000"), (0, 1, "aaa", 150, "1000000"), (1, 0, "bbb", 150, "1000001"), (2, 0, "第二章", 5, "1000002"), (2, 1, "sho", 5, "1000002"), (3, 0, "ccc", 700, "1000003"),
    ]
    with pytest.raises(ValueError):
        c.chunk_novels(spark.range(1).select("id", F.lit("x").alias("text")), "id", chunk_chars=199)


def test_render(spark):
    df = spark.createDataFrame([(0, 0, "self", "hi"), (0, 1, "other", "yo")], "block_id int, idx int, direction string, content string")
    assert c.render_blocks(df, [], F.lit("Ada")).first().rendered == f"[0] Ada: hi\n[1] {c.OTHER_PARTY}: yo"
    assert c.render_blocks(df, []).first().rendered == "[0] hi\n[1] yo"
