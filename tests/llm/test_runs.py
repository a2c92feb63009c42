"""Periodic runs against brute force: every start and period of every text."""

import hashlib
import os
import random
import zlib

import numpy as np
import pytest

from sparkloom.llm import runs
from sparkloom.llm.runs import op13_periodic_runs, overlap, periodic_runs


def brute(words, shortest=6, times=4):
    """All runs (start, length, smallest period) by trying every period from every word."""
    found, n = {}, len(words)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(shortest, times * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def collapse(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def looped(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(doc_id, text):
    words = looped(doc_id, [w.decode() for w in (text or "").encode().split()])
    found = brute(words)
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    return (doc_id, len(found), *best, None if not found else 1000 * best[1] // best[2], digest("".join(f"{s},{n},{q}\n" for s, n, q in found)), digest(collapse(words, found)))


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return list(b[:n])


def thue_morse(n):
    return ["ab"[bin(i).count("1") % 2] for i in range(n)]


def texts(seed=3, n=150):
    rng = random.Random(seed)
    out = [[], ["a"], ["a"] * 5, ["a"] * 6, ["a", "b"] * 3, ["a", "b"] * 4, ["x"] + ["a"] * 900 + ["y"], fibonacci(1500), thue_morse(5000), thue_morse(2048) * 4 + ["x"], (["a"] * 6 + ["b"]) * 40, ["b", "a"] * 5 + ["a", "b"] * 5]
    for _ in range(n):
        words = []
        for _ in range(rng.randrange(1, 6)):
            p = [rng.choice("abc" if rng.random() < 0.5 else "abcdefghijklmnop") for _ in range(rng.randrange(1, 12))]
            words += (p * rng.randrange(1, 9))[: rng.randrange(1, 60)]
        out.append(words)
    return out


def test_against_brute_force(spark, rows):
    all_words = texts()
    docs = spark.createDataFrame([(i, " \n".join(w), i) for i, w in enumerate(all_words)], "doc_id long, text string, runs_ int")
    got = {r.doc_id: r for r in periodic_runs(docs).collect()}
    for i, words in enumerate(all_words):
        want = brute(words)
        assert [(r.start, r.length, r.period) for r in got[i].runs] == want, i
        assert got[i].collapsed == collapse(words, want)


def test_other_bounds():
    for shortest, times in ((9, 4), (4, 5), (20, 6)):
        for words in texts(11, 60):
            ids = np.array([hash(w) % 2**62 for w in words], dtype=np.uint64)
            s, e, q = runs.runs_of(ids, np.array([0, len(ids)]), shortest, times)
            assert list(zip(s.tolist(), (e - s).tolist(), q.tolist())) == brute(words, shortest, times)


def test_masking():
    assert overlap() == 5 and overlap(9, 4) == 7 and overlap(4, 6) == 5
    ids = np.array([hash(w) % 2**62 for w in [str(i) for i in range(50)] + ["a", "b"] * 6 + [str(i) for i in range(60, 90)]], dtype=np.uint64)
    a, z = runs.segments(ids, np.array([0, len(ids)]), 5)
    assert (a.tolist(), z.tolist()) == ([50], [62])
    # a k-gram that only two texts share masks nothing
    a, z = runs.segments(np.concatenate([ids[:20], ids[:20]]), np.array([0, 20, 40]), 5)
    assert len(a) == 0


def test_colliding_base_is_left(monkeypatch):
    words = thue_morse(4096)
    ids = np.array([hash(w) % 2**62 for w in words], dtype=np.uint64)
    monkeypatch.setattr(runs, "BASES", (0, 1, *runs.BASES))  # with 0 and 1 nearly everything is equal
    s, e, q = runs.runs_of(ids, np.array([0, len(ids)]))
    assert list(zip(s.tolist(), (e - s).tolist(), q.tolist())) == brute(words)


def test_edge_cases(spark):
    rows = [(1, None, "x"), (2, "", "x"), (2, "a a a a a a a", "y"), (None, "b b b b b b", "z"), (2, "a a a a a a a", "y"), (3, "            é é", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string")
    out = periodic_runs(docs)
    assert out.columns == ["doc_id", "text", "a.b", "runs", "collapsed"]
    got = sorted(((r[0] or 0, r[2] or "", [tuple(x) for x in r.runs], r.collapsed) for r in out.collect()), key=repr)
    assert got == sorted([(1, "x", [], ""), (2, "x", [], ""), (2, "y", [(0, 7, 1)], "a"), (0, "z", [(0, 6, 1)], "b"), (2, "y", [(0, 7, 1)], "a"), (3, "", [(0, 6, 1)], "  é é")], key=repr)
    assert periodic_runs(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        periodic_runs(docs, times=3)


def test_long_text_of_one_word(spark):
    docs = spark.createDataFrame([(1, "a " * 200_000 + "b " * 200_000)], "doc_id long, text string")
    (r,) = periodic_runs(docs).collect()
    assert [tuple(x) for x in r.runs] == [(0, 200_000, 1), (200_000, 200_000, 1)] and r.collapsed == "a b"


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
def test_query(spark):
    sf = "/root/testdata/sf0.001"
    want = sorted(expected(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    got = sorted(tuple(r) for r in op13_periodic_runs(spark, sf).collect())
    assert got == want
    assert sum(r[1] > 0 for r in got) > 5


def test_query_with_odd_rows(spark, tmp_path):
    rows = [(i, " ".join("ab"[j % 2] for j in range(i % 40))) for i in range(60)] + [(None, "a a a a a a"), (5, None), (5, "c c c c c c c"), (1 << 62, "x")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in op13_periodic_runs(spark, str(tmp_path)).collect()), key=repr)
    want = [expected(d, t) if d is not None else (None, 1, 0, 6, 1, 6000, digest("0,6,1\n"), digest("a")) for d, t in rows]
    assert got == sorted(want, key=repr)
