"""The corpus pipeline on planted cases, and the registered queries on the smallest tables."""

import os
import random

import duckdb
import pytest

import corpus_pipeline
from sparkloom.llm import mixing, pii
from sparkloom.llm import queries as llm

SF = "/root/testdata/sf0.001"
ITEM = "which of these rivers flows north through the old town and past the mill before it meets the sea"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(11)
    path = tmp_path_factory.mktemp("corpus")
    word = lambda: f"w{rng.randrange(900)}"
    rows, labels = [], []
    for i in range(600):
        w = [word() for _ in range(rng.randrange(20, 60))]
        if i % 6 == 0:
            w.insert(5, rng.choice(["idiot", "moron", "scum"]))
        rows.append([i, " ".join(w)])
        labels.append((i, 1, int(i % 6 == 0)))
    toxic = {i for i in range(0, 600, 6)}
    copies, leaks, private = {}, set(), {}
    for k, i in enumerate(range(1, 61, 6)):  # copies of clean documents, exact and with one word changed
        w = rows[i][1].split()
        w[-1] = w[-1] if k % 2 else "changed"
        copies[700 + k] = i
        rows.append([700 + k, " ".join(w)])
    for k in range(8):
        leaks.add(800 + k)
        rows.append([800 + k, " ".join(word() for _ in range(20)) + " " + ITEM + " " + word()])
    for k in range(8):
        private[900 + k] = f"user{k}@mail.example.com"
        rows.append([900 + k, " ".join(word() for _ in range(30)) + " " + private[900 + k]])
    rows += [[1000, None], [1001, ""], [None, "no id here"], [1002, "repeated row of text"], [1002, "repeated row of text"]]
    docs = spark.createDataFrame([(d, t, "en", f"s{(d or 0) % 4}", len(t or ""), "x") for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, toxicity string")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), rows, toxic, copies, leaks, private


def test_stages(spark, corpus, tmp_path):
    path, rows, toxic, copies, leaks, private = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    ids = [d for d, _ in rows]
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        left[name] = {r.doc_id: r for r in docs.collect()}, docs.count()
    found = left["toxicity"][0]
    assert len(toxic - found.keys()) >= 0.95 * len(toxic) and all(d in found for d in ids if d not in toxic)
    after, n = left["near_dedup"]
    assert not copies.keys() & after.keys() and all(d in after for d in found if d not in copies) and n == len(after)
    clean, _ = left["decontamination"]
    assert clean.keys() == after.keys() - leaks
    safe, _ = left["pii"]
    for d, r in safe.items():
        if d in private:
            assert private[d] not in r.text and pii.pseudonymise(clean[d].text)[0] == r.text and r.n_chars == len(r.text)
        else:
            assert r == clean[d]
    _, n = left["mixing"]
    want = mixing.copies(spark, spark.read.parquet(f"{tmp_path}/pii")).agg({"__mix_copies": "sum"}).first()[0]
    assert n == want and corpus_pipeline.run(spark, path).count() == n


def test_names_and_repeated_ids(spark, corpus, tmp_path):
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(900)}"
    one, two, near = (" ".join(word() for _ in range(40)) for _ in range(3))
    rows = [(1, one), (1, two), (1, one), (2, one + " more"), (None, two), (None, near), (3, near), (4, None), (4, ""), (5, None), (6, "mail me@example.com")]
    docs = spark.createDataFrame([(d, t, "a", "en", i, 1, 2, {"k": 1}) for i, (d, t) in enumerate(rows)], "doc_id long, text string, source string, `meta.lang` string, __row long, __mix_size int, `a``b` int, m map<string,int>")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, corpus[0])
        assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name == "near_dedup":
            kept = sorted(((r.doc_id, r.text) for r in docs.collect()), key=repr)
            assert kept == sorted([(1, one), (1, two), (3, near), (4, None), (4, ""), (5, None), (6, "mail me@example.com")], key=repr)
    assert docs.filter("doc_id = 6").first()["meta.lang"] == "en"


def test_empty(spark, corpus, tmp_path):
    path = corpus[0]
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{path}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    for name in ("op1_substring_dedup", "op2_katz", "op4_mixing", "op5_toxicity", "op6_decontamination", "op7_minhash_near_dedup", "op9_pii_pseudonyms", "op11_order_minhash", "op12_lexical_search", "op13_periodic_runs"):
        assert llm.queries()[name](spark, str(tmp_path)).count() == 0


def test_registered_queries(spark):
    if not os.path.isdir(SF):
        pytest.skip("no tables")
    con = duckdb.connect()
    n = {}
    for t in ("documents", "pages", "labels", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
        n[t] = con.execute(f"SELECT count(*) FROM {t}").fetchone()[0] if hasattr(con, "fetchone") else con.execute(f"SELECT count(*) FROM {t}").fetchall()[0][0]
    whole = {"op1_substring_dedup": "documents", "op2_katz": "documents", "op3_warc": "pages", "op4_mixing": "documents", "op5_toxicity": "documents", "op7_minhash_near_dedup": "documents", "op8_url_reputation": "pages", "op9_pii_pseudonyms": "documents", "op10_embedding_near_dedup": "embeddings", "op11_order_minhash": "documents", "op13_periodic_runs": "documents"}
    for name, table in whole.items():
        assert llm.queries()[name](spark, SF).count() == n[table], name
    plain = lambda rows: sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)
    for name, sql in llm.oracle_sql().items():
        r = con.execute(sql)
        cols = [d[0] for d in r.description]
        assert plain(r.fetchall()) == plain([x[c] for c in cols] for x in llm.queries()[name](spark, SF).collect()), name
