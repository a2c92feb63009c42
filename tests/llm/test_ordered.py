"""Order MinHash against its definition, item by item; order of rows; likeness and edit distance."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import ordered
from sparkloom.llm.ordered import Points, edited, fingerprints, likeness, op11_order_minhash, sketch
from sparkloom.llm.text import GOLDEN, Texts, U, mix, rolling

DOCS = "doc_id long, text string"
M = 2**64 - 1


def mixed(x):
    return int(mix(np.array([x & M], dtype=np.uint64))[0])


def brute(text, k=ordered.K, tuple_=ordered.TUPLE, seeds=ordered.SEEDS, points=ordered.POINTS):
    codes = np.array([ord(c) for c in text], dtype=np.uint64)
    if not text:
        return "0" * 4 * seeds * points
    if len(text) < k:
        grams = [int.from_bytes(hashlib.blake2b(codes.tobytes(), digest_size=8).digest(), "little")]
    else:
        grams = [int(rolling(mix(codes[i : i + k] + U(1)), k)[0]) for i in range(len(text) - k + 1)]
    seen, items = {}, []
    for g in grams:
        items.append(mixed(g + seen.get(g, 0) * 0xD6E8FEB86659FD93))
        seen[g] = seen.get(g, 0) + 1
    out = ""
    for seed in range(seeds):
        ring = [mixed(x + seed * int(GOLDEN)) >> 16 for x in items]
        for j in range(points):
            nearest = sorted(range(len(items)), key=lambda i: ((ring[i] - j * 2**48 // points) % 2**48, i))[:tuple_]
            value = seed + 1
            for i in sorted(nearest):
                value = mixed((value * int(GOLDEN) & M) ^ grams[i])
            out += f"{value >> 48:04x}"
    return out


def texts(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéß世") for _ in range(rng.randrange(1, 9)))
    vocabulary = [word() for _ in range(60)]
    out = ["", "a", "abcdefg", "abcdefgh", "abcdefghi", "a" * 50, "ab" * 700, "𝄞" * 9]
    out += [" ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 20, 100, 700]))) for _ in range(16)]
    return out


def of(all_texts, **more):
    p = Points(Texts(pa.array(all_texts, pa.string())))
    return [r.tobytes().hex() for r in sketch(p.of, p.first, **more).astype(">u2")]


def test_against_definition():
    some = texts()
    assert of(some) == [brute(t) for t in some]
    assert of(some, near=1) == of(some)  # too few items near most points: all of them are sorted
    assert of(some[::-1]) == of(some)[::-1] and of(some[20:21]) == of(some)[20:21]
    small = dict(k=3, tuple_=4, seeds=1, points=8)
    assert of(some, **small) == [brute(t, **small) for t in some]


def test_bytes_that_are_no_text():
    p = Points(Texts(pa.array([b"ab\xffcd", b"", b"xy"], pa.binary())))
    assert np.diff(p.first).tolist() == [5, 0, 2] and p.cut(0, 3) == "ab�".encode() and p.cut(2, 1) == b"x"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def test_likeness_falls_with_edits():
    rng = random.Random(7)
    text = " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(60))
    versions = [text]
    for share in (0.01, 0.03, 0.1, 0.4):
        versions.append("".join(rng.choice("klm") if rng.random() < share else c for c in text))
    versions.append("".join(rng.choice("abcdefghij ") for _ in text))
    own, *others = (np.array([int(f[i : i + 4], 16) for i in range(0, len(f), 4)]) for f in of(versions))
    near = [(own == o).mean() for o in others]
    far = [distance(text, v) for v in versions[1:]]
    assert sorted(far) == far and sorted(near, reverse=True) == near and near[0] > 0.6 and near[-1] < 0.02


def test_order_matters():
    """The same passages in another order: nearly the same k-mers, other tuples."""
    rng = random.Random(3)
    parts = ["".join(rng.choice("abcdefghijklmnop") for _ in range(150)) for _ in range(8)]
    a, b = of(["".join(parts), "".join(parts[::-1])], seeds=4)
    c, d = of(["".join(parts), "".join(parts[::-1])], seeds=4, tuple_=1)
    share = lambda x, y: np.mean([x[i : i + 4] == y[i : i + 4] for i in range(0, len(x), 4)])
    assert share(c, d) > 0.6 and share(a, b) < 0.5 * share(c, d)


def test_operator(spark):
    rows = [(1, "one text here", 1), (None, "one text here", 2), (2, None, 3), (2, "", 4), (3, "one text there", 5)]
    docs = spark.createDataFrame(rows, DOCS + ", `fingerprint.x` int")
    out = fingerprints(docs)
    assert out.columns == [*docs.columns, "fingerprint"]
    got = {r[2]: r.fingerprint for r in out.collect()}
    assert got[1] == got[2] == brute("one text here") and got[3] == got[4] == "0" * 512
    pairs = spark.createDataFrame([(got[1], got[2]), (got[1], got[5]), (got[1], got[3])], "a string, b string")
    same = lambda a, b: sum(a[i : i + 4] == b[i : i + 4] for i in range(0, len(a), 4)) / 128
    assert [r[0] for r in pairs.select(likeness(F.col("a"), F.col("b"))).collect()] == [1.0, same(got[1], got[5]), 0.0]
    assert fingerprints(docs.limit(0)).collect() == []


def expected(rows):
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for (d, t), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        n = len(t) // 3
        e = t[: len(t) - n] + after[:n]
        a, b, c = brute(t), brute(e), brute(after)
        same = lambda x, y: sum(x[i : i + 4] == y[i : i + 4] for i in range(0, len(x), 4)) / 128
        out.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), a, b, same(a, b), same(a, c)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("partitions", [1, 4])
def test_edited(spark, partitions, monkeypatch):
    monkeypatch.setattr(ordered, "SLICE", 3000)
    rows = [(i * 7 - 50, t) for i, t in enumerate(texts(5) + texts(6))] + [(9999, None)]
    docs = spark.createDataFrame([(*r, 0) for r in rows], DOCS + ", bucket int").repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        got = sorted((tuple(r) for r in edited(docs).collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == expected(rows)


def test_edited_few_rows(spark):
    assert edited(spark.createDataFrame([], DOCS)).collect() == []
    for rows in ([(4, "abcdefghijkl")], [(None, "abcdefghijkl")], [(None, None), (None, None)], [(1, "x" * 30), (2, "")]):
        got = sorted((tuple(r) for r in edited(spark.createDataFrame(rows, DOCS)).collect()), key=repr)
        assert got == expected(rows)


def test_edited_hot_ids(spark):
    """Most rows have the same id or none: they are dealt out by their texts, and each still has one next row."""
    rng = random.Random(2)
    rows = [(7, f"seven {rng.random()} and more") for _ in range(150)] + [(None, f"none {rng.random()} of it") for _ in range(150)] + [(i, f"text {i} " * 3) for i in range(40)] + [(7, "same text of seven")] * 20
    docs = spark.createDataFrame(rows, DOCS)
    plan = ordered.in_order(docs)
    assert plan.filter("NOT ahead").select("bucket", "sub").distinct().count() > 30
    got = edited(docs).collect()
    assert len(got) == len(rows)
    assert sorted(r.fingerprint for r in got) == sorted(brute(t) for _, t in rows)
    # within an id, rows follow each other by their texts' hash, and the last one is followed by the next id's first
    h = {t: x for t, x in docs.select("text", F.xxhash64("text")).distinct().collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), h[r[1]]))
    want = sorted(hashlib.sha256((t[: len(t) - len(t) // 3] + u[: len(t) // 3]).encode()).hexdigest() for (_, t), (_, u) in zip(order, order[1:] + order[:1], strict=True))
    assert sorted(r.edited_sha256 for r in got) == want


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    some = {d for d, t in rows if len(t or "") < 400}
    got = {r.doc_id: tuple(r) for r in op11_order_minhash(spark, sf).collect()}
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda r: -r[0])
    for (d, t), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        n = len(t) // 3
        e = t[: len(t) - n] + after[:n]
        assert got[d][1:3] == (len(t), hashlib.sha256(e.encode()).hexdigest())
        if d in some:
            assert got[d][3:5] == (brute(t), brute(e))
    near, next_ = (np.mean([r[i] for r in got.values()]) for i in (5, 6))
    assert near > 0.15 and near > 3 * next_
