"""World-Info and guards against sequential simulations."""

import hashlib
import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import worldinfo as wi

ENTRY = "entry_id long, keys array<string>, second array<string>, logic string, content string, constant boolean, priority int, sticky int, cooldown int, delay int, probability int, exempt boolean, cost int, pool string, weight int"
WORDS = ["sea", "Tea", "hill", "海", "storm", "inn", "road"]


def draw(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:8], 16)


def book(rng, n=14):
    pick = lambda k: rng.sample(WORDS, k)
    rows = [
        (i, pick(rng.randrange(3)), pick(rng.choice([0, 0, 1, 2])), rng.choice([*wi.LOGIC, None]), " ".join(pick(2)), rng.random() < 0.15, rng.choice([None, 1, 5]), rng.choice([None, 0, 1, 3]), rng.choice([None, 0, 2]), rng.choice([None, 0, 3]), rng.choice([None, 50, 100]), rng.random() < 0.2, rng.randrange(1, 50), rng.choice([None, "a", "b"]), rng.choice([None, 1, 20]))
        for i in range(n)
    ]
    return [*rows, (90, None, None, None, None, None, None, None, None, None, None, None, None, None, None), (91, ["", "SEA"], None, "and_any", "", False, 1, 0, 0, 0, None, None, 1, None, 1)]


def talk(rng):
    return [(c, t * 3 + 5, None if rng.random() < 0.1 else " ".join(rng.choice([*WORDS, "and", "SEAside"]) for _ in range(rng.randrange(4)))) for c in range(4) for t in range(rng.randrange(1, 14))]


def has(text, keys):
    return {k.lower() for k in keys or [] if k and k.lower() in (text or "").lower()}


def scanned(messages, entries, depth):
    out = set()
    for c in {m[0] for m in messages}:
        said = [m[2] for m in sorted((m for m in messages if m[0] == c), key=lambda m: m[1])]
        for p in range(len(said)):
            near = said[max(0, p - depth + 1) : p + 1] if depth else []
            for e in entries:
                first, second = (set().union(*(has(t, e[i]) for t in near)) for i in (1, 2))
                of = {k.lower() for k in e[2] or [] if k}
                ok = not of or {"and_all": len(second) == len(of), "not_any": not second, "not_all": len(second) < len(of)}.get(e[3], bool(second))
                if e[5] or (first and ok):
                    out.add((c, p, e[0]))
    return out


@pytest.mark.parametrize("depth", [0, 1, 3, 50])
def test_scan(spark, depth):
    rng = random.Random(depth)
    m, e = talk(rng), book(rng)
    got = wi.scan(spark.createDataFrame(m, "conv long, turn long, text string"), spark.createDataFrame(e, ENTRY), depth)
    assert {tuple(r) for r in got.collect()} == scanned(m, e, depth) and got.count() == got.distinct().count()


def test_timed(spark):
    rng = random.Random(5)
    m, e = talk(rng), book(rng)
    by = {x[0]: x for x in e}
    called = scanned(m, e, 2)
    sizes = {c: sum(x[0] == c for x in m) for c in range(4)}
    want = set()
    for c, i in {(c, i) for c, _, i in called}:
        _, _, _, _, _, _, _, sticky, cooldown, delay, p, *_ = by[i]
        free = 0
        for place in sorted(q for d, q, j in called if (d, j) == (c, i)):
            if place >= free and place + 1 >= (delay or 0) and draw(c, i, place) < (100 if p is None else p) * 2**32 / 100:
                want |= {(c, q, i, place) for q in range(place, min(place + (sticky or 0), sizes[c] - 1) + 1)}
                free = place + 1 + (sticky or 0) + (cooldown or 0)
    messages, entries = spark.createDataFrame(m, "conv long, turn long, text string"), spark.createDataFrame(e, ENTRY)
    got = wi.timed(spark.createDataFrame(sorted(called), "conv long, place long, entry_id long"), entries, messages)
    assert sorted(map(tuple, got.select("conv", "place", "entry_id", "begun").collect())) == sorted(want)
    assert wi.timed(wi.scan(messages.limit(0), entries, 2), entries, messages).collect() == []


@pytest.mark.parametrize("steps", [0, 1, 2, 6])
def test_recursion(spark, steps):
    rng = random.Random(steps)
    e = book(rng, 20)
    active = {(c, p, rng.randrange(20)) for c in range(2) for p in range(4) for _ in range(2)}
    level = {}
    for c, p in {a[:2] for a in active}:
        front = {i for d, q, i in active if (d, q) == (c, p)}
        level |= {(c, p, i): 0 for i in front}
        for n in range(1, steps + 1):
            front = {b[0] for b in e for a in e if a[0] in front and a[0] != b[0] and not b[11] and not b[2] and has(a[4], b[1])}
            front = {i for i in front if (c, p, i) not in level}
            level |= {(c, p, i): n for i in front}
    entries = spark.createDataFrame(e, ENTRY)
    got = wi.recursed(spark.createDataFrame(sorted(active), "conv long, place long, entry_id long"), entries, steps)
    assert {(r.conv, r.place, r.entry_id): r.level for r in got.collect()} == level


def test_pools_and_budget(spark):
    rng = random.Random(9)
    e = book(rng)
    by = {x[0]: x for x in e}
    active = sorted({(c, p, rng.randrange(14), rng.randrange(3)) for c in range(3) for p in range(6) for _ in range(6)})
    active = list({a[:3]: a for a in active}.values())
    entries, df = spark.createDataFrame(e, ENTRY), spark.createDataFrame(active, "conv long, place long, entry_id long, level int")
    kept = set()
    for turn in {a[:2] for a in active}:
        of = [a for a in active if a[:2] == turn]
        kept |= {a for a in of if by[a[2]][13] is None}
        for pool in "ab":
            if some := [a for a in of if by[a[2]][13] == pool]:
                kept.add(min(some, key=lambda a: (-math.log((draw(*a[:3]) + 1) / (2**32 + 1)) / (by[a[2]][14] or 1), a[2])))
    got = wi.one_of_each_pool(df, entries)
    assert {tuple(r) for r in got.collect()} == kept and got.columns == df.columns
    for budget in (0, 60, 10_000):
        want = []
        for turn in {a[:2] for a in active}:
            spent = 0
            order = sorted((a for a in active if a[:2] == turn), key=lambda a: (not by[a[2]][5], -(by[a[2]][6] or -1), a[3] > 0, a[2]))
            for rank, a in enumerate(order, 1):
                spent += by[a[2]][12] or 0
                if spent > budget:
                    break
                want.append((*a[:3], rank, spent))
        assert sorted(map(tuple, wi.within_budget(df, entries, budget).collect())) == sorted(want)


def test_draws_follow_the_weights(spark):
    entries = spark.createDataFrame([(1, "p", 1), (2, "p", 3)], "entry_id long, pool string, weight int")
    active = spark.range(4000).select(F.lit(1).alias("conv"), F.col("id").alias("place")).join(entries.select("entry_id"))
    assert 0.7 < wi.one_of_each_pool(active, entries).filter("entry_id = 2").count() / 4000 < 0.8


def test_all_steps(spark):
    rng = random.Random(1)
    m, e = spark.createDataFrame(talk(rng), "conv long, turn long, text string"), spark.createDataFrame(book(rng), ENTRY)
    first = sorted(map(tuple, wi.activate(m, e, 3, 2, 100).collect()))
    assert first and first == sorted(map(tuple, wi.activate(m.repartition(7), e, 3, 2, 100).collect()))
    assert wi.activate(m.limit(0), e).collect() == [] and wi.activate(m, e.limit(0)).collect() == []


@pytest.mark.parametrize("hours", [(8, 22), (22, 6), (0, 24)])
def test_guards(spark, hours):
    rng = random.Random(hours[0])
    a, z = hours
    rows, at = [], datetime(2026, 1, 1)
    for i in range(300):
        at += timedelta(minutes=rng.choice([0, 5, 30, 200, 700]))
        rows.append((rng.choice(["a", "b", None]), i, at if rng.random() < 0.95 else None))
    want, state = {}, {}
    for who, i, t in sorted(rows, key=lambda r: (r[2] is not None, r[2] or at, r[1])):
        day, n, last = state.get(who, (None, 0, None))
        if t is None:
            want[i] = False
            continue
        n = n if day == t.date() else 0
        inside = a <= t.hour < z if a <= z else t.hour >= a or t.hour < z
        lucky = draw(*([] if who is None else [who]), i) < 70 * 2**32 / 100
        want[i] = inside and lucky and n < 2 and (last is None or t - last >= timedelta(minutes=60))
        state[who] = (t.date(), n + want[i], t if want[i] else last)
    df = spark.createDataFrame(rows, "who string, n long, t timestamp_ntz").withColumn("t", F.col("t").cast("timestamp"))
    got = wi.guarded(df, ["who"], "t", "n", 2, 60, hours, 70)
    assert {r.n: r.sent for r in got.collect()} == want and got.columns == ["who", "n", "t", "sent"] and any(want.values())
    assert wi.guarded(df.limit(0), ["who"], "t", "n", 2, 60, hours).collect() == []


def test_recursion_makes_no_row_for_each_way(spark, rows):
    """A turn whose 40 entries all call up the same 40 is 40 rows, not 1,600, on its way to the answer."""
    entries = spark.createDataFrame([(i, ["heart"] if i >= 40 else [f"no{i}"], [], "and_any", "my heart" if i < 40 else "x", False) for i in range(80)], "entry_id long, keys array<string>, second array<string>, logic string, content string, exempt boolean")
    active = spark.createDataFrame([(1, p, i) for p in range(3) for i in range(40)], "conv int, place long, entry_id long")
    got = wi.recursed(active, entries, 2)
    assert rows(got) == sorted([(1, p, i, int(i >= 40)) for p in range(3) for i in range(80)], key=repr)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join LeftOuter") == 1  # an entry with its lists, one row
    assert rows(wi.recursed(active, entries, 0)) == rows(active.selectExpr("*", "0 AS level"))
