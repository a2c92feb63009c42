"""Ranked search against brute force, its blocks against the exact least cost, and what it skips."""

import math
import os
import random
import re

import duckdb
import numpy as np
import pytest

from sparkloom.llm import search
from sparkloom.llm.search import OP12_SQL, SearchIndex, Shard, cut, op12_lexical_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string"


def terms(text):
    return TERM.findall((text or "").translate(FOLD))


def brute(docs, queries, k):
    docs = [(d, terms(t)) for d, t in docs]
    n_docs, n_terms = sum(bool(t) for _, t in docs), sum(len(t) for _, t in docs)
    df = {}
    for _, t in docs:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    out = []
    for item, text in queries:
        if item is None or text is None:
            continue
        found = []
        for d, t in docs:
            score = 0
            for x in set(terms(text)):
                if tf := t.count(x):
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1)))
                    score += w * (1_000_000_000 * tf // (1000 * tf + 20 * (50 + 50 * len(t) * n_docs // n_terms)))
            if score > 0:
                found.append((-score, d is None, d, score))
        out += [(item, i + 1, d, s) for i, (_, _, d, s) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=repr)


def results(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def corpus(seed=2, n=400):
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "of"]) if rng.random() < 0.3 else f"w{int(rng.paretovariate(0.7)) % 300}"
    docs = [(i, rng.choice([" ", "-", "\n", "\x7f"]).join(word() for _ in range(rng.randrange(0, 60)))) for i in range(n)]
    docs += [(n, None), (n + 1, ""), (n + 2, "?!"), (None, docs[3][1]), (None, docs[3][1]), (5, docs[3][1]), (n + 3, docs[3][1]), (n + 4, "Äpfel ÄPFEL äpfel THE"), (n + 5, "w1 " * 4000)]
    queries = [(1, "w1 w2 W3 the"), (2, docs[3][1]), (3, "Äpfel"), (4, "nowhere at all"), (5, None), (None, "w1"), (6, ""), (7, " ".join(f"w{i}" for i in range(300))), (8, "the"), (2, "w5")]
    return docs, queries


@pytest.mark.parametrize("k, size", [(50, 8 << 20), (7, 2000), (1, 300)])
def test_against_brute_force(spark, monkeypatch, k, size):
    docs, queries = corpus()
    monkeypatch.setattr(search, "SHARD_BYTES", size)
    table = spark.createDataFrame([(*d, "x") for d in docs], DOCS + ", term string").repartition(3)
    got = results(SearchIndex(spark, table).search(spark.createDataFrame(queries, "item_id long, text string"), k))
    assert got == brute(docs, queries, k)


def test_queries_in_several_blocks(spark, monkeypatch):
    docs, queries = corpus(4, 80)
    monkeypatch.setattr(search, "query_blocks", lambda q, f=search.query_blocks: f(q, 100))
    got = results(SearchIndex(spark, spark.createDataFrame(docs, DOCS)).search(spark.createDataFrame(queries, "item_id long, text string"), 5))
    assert got == brute(docs, queries, 5)


def test_empty_tables(spark):
    docs, queries = (spark.createDataFrame([], s) for s in (DOCS, "item_id long, text string"))
    some = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert results(SearchIndex(spark, docs).search(some)) == []
    assert results(SearchIndex(spark, some.toDF("doc_id", "text")).search(queries)) == []
    assert results(SearchIndex(spark, spark.createDataFrame([(1, "..."), (2, None)], DOCS)).search(some)) == []


def cost_of(values, ends, fee):
    total, a = 0.0, 0
    for z in ends:
        total, a = total + (z - a) * max(values[a:z]) + fee, z
    return total


def least(values, most, fee):
    best = [0.0]
    for z in range(1, len(values) + 1):
        best.append(min(best[a] + (z - a) * max(values[a:z]) + fee for a in range(max(0, z - most), z)))
    return best[-1]


def test_blocks_cost_least():
    rng = random.Random(1)
    for most in (1, 3, 32):
        all_of = [[int(rng.paretovariate(1) * 100) for _ in range(rng.randrange(1, 90))] for _ in range(25)]
        first = np.cumsum([0, *map(len, all_of)])
        ends, n = cut(np.array(sum(all_of, [])), first, most)
        for v, e in zip(all_of, np.split(ends, np.cumsum(n)[:-1]), strict=True):
            e = e.tolist()
            fee = search.PRICE * sum(v) / len(v)
            assert e[-1] == len(v) and all(z - a <= most for a, z in zip([0, *e], e, strict=False))
            assert cost_of(v, e, fee) == pytest.approx(least(v, most, fee))


def test_blocks_are_skipped():
    """Few documents of a rare term bound the rest away: most postings of the common term are not read, and nothing is lost."""
    rng = np.random.default_rng(0)
    n = 20_000
    common, rare = np.arange(n), np.sort(rng.choice(n, 60, replace=False))
    rows = [{"term": None, "ids": search.pa.array(np.arange(n))}]
    for name, docs in (("common", common), ("rare", rare)):
        value = rng.integers(100, 1000, len(docs))
        ends, _ = cut(value, np.array([0, len(docs)]))
        tops = np.maximum.reduceat(value, np.append(0, ends[:-1]))
        rows.append({"term": name, "docs": docs, "impacts": value, "ends": ends, "tops": tops})
    shard = Shard(rows)
    doc, score, read = shard.search([("common", 3), ("rare", 5000)], 50)
    whole = np.zeros(n)
    whole += 3 * rows[1]["impacts"]
    whole[rare] += 5000 * rows[2]["impacts"]
    want = np.lexsort((np.arange(n), -whole))[:50]
    order = np.lexsort((doc, -score))[:50]
    assert doc[order].tolist() == want.tolist() and score[order].tolist() == whole[want].tolist()
    assert read < 0.2 * n


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
def test_query_and_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = results(op12_lexical_search(spark, sf))
    assert got == sorted(con.execute(OP12_SQL).fetchall(), key=repr)
    docs, queries = ([tuple(r) for r in spark.read.parquet(f"{sf}/{t}.parquet").select(c, "text").collect()] for t, c in (("documents", "doc_id"), ("benchmark", "item_id")))
    assert got == brute(docs, queries, 50)
