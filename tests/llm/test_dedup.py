"""Substring dedup, MinHash near-dedup and embedding near-dedup against brute force, and their edge cases."""

import hashlib
import os
import random

import duckdb
import numpy as np
import pytest

from sparkloom.llm import minhash
from sparkloom.llm.embeddings import near_duplicates, plan
from sparkloom.llm.minhash import NearDuplicates
from sparkloom.llm.substrings import SubstringIndex, dedup

DOCS = "doc_id long, text string"


def words(rng, n, vocab=500):
    return [f"w{rng.randrange(vocab)}" for _ in range(n)]


def brute_substrings(rows, width):
    docs = [(d, (t or "").encode().split()) for d, t in rows]
    first = {}
    for d, w in docs:
        for i in range(len(w) - width + 1):
            if d is not None:
                k = tuple(w[i : i + width])
                first[k] = min(first.get(k, d), d)
    out = []
    for d, w in docs:
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if d is not None and first[tuple(w[i : i + width])] < d:
                gone[i : i + width] = [True] * width
        out.append((d, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return sorted(out, key=repr)


def results(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in df.collect()), key=repr)


def corpus(seed=5):
    rng = random.Random(seed)
    shared, long = words(rng, 60), words(rng, 400)
    rows = []
    for i in range(60):
        w = words(rng, rng.randrange(0, 90))
        kind = i % 6
        if kind == 0:
            at = rng.randrange(len(w) + 1)
            w[at:at] = shared[rng.randrange(5) : 60 - rng.randrange(5)]
        elif kind == 1:
            w = list(long)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = "edit"
        elif kind == 2:
            w = ["a", "b"] * rng.randrange(40)
        rows.append((i * 3 % 60 + i // 20, rng.choice([" ", "\n", "\t ", "\x0b"]).join(w)))
    # repeated ids and rows, null id, null and empty texts, other white space inside words
    return [*rows, (7, " ".join(long)), (1000, rows[1][1]), (None, " ".join(long)), (1001, None), (1002, ""), (1003, "x\u00a0y " * 60), (1004, "x\u00a0y " * 60), (1004, "x\u00a0y " * 60)]


@pytest.mark.parametrize("batches", [1, 3])
def test_substrings(spark, batches):
    rows = corpus()
    got = dedup(spark, spark.createDataFrame([(*r, 1) for r in rows], DOCS + ", kept int"), batches)
    assert results(got) == brute_substrings(rows, 50)
    for r in got.collect():
        assert sum(s.end - s.start for s in r.spans) == r.n_removed


def test_substring_runs_are_merged(spark):
    rows = [r for r in corpus(9) if r[0] is not None]
    index, out = SubstringIndex(spark, fanout=2, buckets=3), []
    order = sorted(range(len(rows)), key=lambda i: rows[i][0])
    ids = sorted({r[0] for r in rows})
    for lo in range(0, len(ids), 14):
        part = {*ids[lo : lo + 14]}
        out += results(index.add(spark.createDataFrame([rows[i] for i in order if rows[i][0] in part], DOCS)))
    assert len(index.runs) <= 4 and max(level for level, _ in index.runs) == 2
    assert sorted(out, key=repr) == brute_substrings(rows, 50)


def test_a_copy_under_a_repeated_id_leaves_the_other_row_alone(spark):
    rng = random.Random(2)
    long, other = " ".join(words(rng, 80)), " ".join(words(rng, 70))
    rows = [(1, long), (2, long), (2, other)]
    for batches in (1, 2):
        got = dedup(spark, spark.createDataFrame(rows, DOCS), batches)
        assert results(got) == brute_substrings(rows, 50)


def test_earlier_batches_come_first_whatever_their_ids(spark):
    rng = random.Random(3)
    a, b = words(rng, 200), words(rng, 90)
    rows = [[(100, " ".join(a))], [(50, " ".join(a)), (60, " ".join(b + a[20:90])), (100, " ".join(a))], [(10, " ".join(b)), (70, " ".join(words(rng, 80)))], [(1, " ".join(b[:70])), (2, " ".join(a))]]
    index = SubstringIndex(spark, fanout=2, buckets=3)
    got = [{r.doc_id: r.n_removed for r in index.add(spark.createDataFrame(x, DOCS)).collect()} for x in rows]
    assert got == [{100: 0}, {50: 200, 60: 70, 100: 0}, {10: 90, 70: 0}, {1: 70, 2: 200}]


def test_an_index_is_reopened_by_another_session(spark, tmp_path):
    """Each batch by an index opened anew, in a session of its own; the result is that of one index."""
    rows = [r for r in corpus(4) if r[0] is not None]
    ids, out, path = sorted({r[0] for r in rows}), [], str(tmp_path / "index")
    for lo in range(0, len(ids), 20):
        part = {*ids[lo : lo + 20]}
        own = spark.newSession()
        index = SubstringIndex(own, fanout=2, buckets=3, path=path)
        assert index.batches == lo // 20
        out += results(index.add(own.createDataFrame([r for r in rows if r[0] in part], DOCS)))
        index.home.close()
        index.ws.close()
    assert sorted(out, key=repr) == brute_substrings(rows, 50)
    again = SubstringIndex(spark, fanout=2, buckets=3, path=path)
    level = {k for k, _ in again.runs}
    plan_ = again.runs[0][1]["anchors"].groupBy("h").count()._jdf.queryExecution().executedPlan().toString()
    assert max(level) >= 1 and "Bucketed: true" in plan_ and "Exchange" not in plan_
    with pytest.raises(ValueError):
        SubstringIndex(spark, width=40, path=path)
    (tmp_path / "index/manifest/_half").write_text("{")  # a manifest that was never renamed
    assert SubstringIndex(spark, path=path).batches == again.batches


def test_only_files_of_woken_documents_are_read(spark, tmp_path, monkeypatch):
    rng, read = random.Random(6), []
    index, texts = SubstringIndex(spark, fanout=2, buckets=2, path=str(tmp_path / "i")), SubstringIndex._texts
    monkeypatch.setattr(SubstringIndex, "_texts", lambda self, at: read.append(at) or texts(self, at))
    docs = {i: " ".join(words(rng, 90, 10**6)) for i in range(60)}
    for batch in range(5):
        rows = [(i, docs[i]) for i in range(batch * 10, batch * 10 + 10)]
        index.add(spark.createDataFrame(rows, DOCS).repartition(4)).collect()
    assert read == [[]] * 4
    got = index.add(spark.createDataFrame([(50, docs[50] + " " + docs[12]), (51, docs[51])], DOCS)).collect()
    assert {r.doc_id: r.n_removed for r in got} == {50: 90, 51: 0}
    assert len(read[-1]) == 1 and read[-1][0] >> 32 == 1  # one file of the second batch
    # now known from two documents: nothing is read any more
    got = index.add(spark.createDataFrame([(60, docs[12])], DOCS)).collect()
    assert [r.n_removed for r in got] == [90] and read[-1] == []


def test_substrings_of_nothing(spark):
    assert dedup(spark, spark.createDataFrame([], DOCS)).count() == 0


def sets_of(text, width):
    w = (text or "").encode()
    w = bytes(c + 32 if 65 <= c <= 90 else c for c in w).split()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())


def brute_near(rows, width, percent):
    ids = sorted({d for d, _ in rows if d is not None})
    root = {d: d for d in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    s = [(d, sets_of(t, width)) for d, t in rows if d is not None]
    for i, (a, x) in enumerate(s):
        for b, y in s[:i]:
            both = len(x & y)
            if both and 100 * both >= percent * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {d: find(d) for d in ids}


def near_corpus(seed=3):
    rng = random.Random(seed)
    base, passage = words(rng, 120), words(rng, 25)
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 5, 8])):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    for i in range(150, 260):
        w = words(rng, rng.randrange(0, 12))
        rows.append((i, " ".join(w + passage[: rng.randrange(15, 26)])))
    for i in range(260, 300):
        w = words(rng, 40)
        rows += [(i, " ".join(w)), (i + 100, " ".join(w[: rng.randrange(30, 41)]).upper())]
    return rows + [(900, None), (901, ""), (902, "One two"), (903, "one  TWO"), (904, "one"), (905, "one"), (905, "one"), (None, rows[0][1]), (None, "alone here and now")]


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates(spark, width, monkeypatch):
    rows = near_corpus()
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], DOCS + ", n long, node string")
    got = NearDuplicates(spark, docs, width, 80).documents().collect()
    want = brute_near(rows, width, 80)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    assert len(got) == len(rows) and all(r.kept == (r.doc_id is None and r.component_id is None or r.doc_id == r.component_id) for r in got if r.doc_id is not None)
    assert {r.n_shingles for r in got if r.doc_id in (900, 901)} == {0} and {r.n_shingles for r in got if r.doc_id in (902, 904)} == {1}
    loose = [r for r in got if r.doc_id is None]
    assert sorted((r.component_id is None, r.kept) for r in loose) == [(False, False), (True, True)]


def test_near_duplicates_through_long_lists_only(spark, monkeypatch):
    monkeypatch.setattr(minhash, "HOT", 4)
    monkeypatch.setattr(minhash, "BLOCK_VALUES", 900)
    rows = near_corpus(8)
    got = NearDuplicates(spark, spark.createDataFrame(rows, DOCS), 4, 80).documents()
    assert {r.doc_id: r.component_id for r in got.collect() if r.doc_id is not None} == brute_near(rows, 4, 80)


def test_long_patterns_of_two_letters_or_words_are_told_apart(spark):
    a, b = "a", "b"
    for _ in range(11):
        a, b = a + b, b + a
    rest = " ".join(f"w{i}" for i in range(60))
    p, q = " ".join("xy" if c == "a" else "yz" for c in a), " ".join("yz" if c == "a" else "xy" for c in a)
    rows = [(1, a), (2, b), (3, f"{rest} {a} {rest}"), (4, f"{rest} {b} {rest}"), (5, p), (6, q), (7, a[:1024]), (8, b[:1024])]
    docs = spark.createDataFrame(rows, DOCS)
    assert {r.doc_id: r.component_id for r in NearDuplicates(spark, docs, 4).documents().collect()} == brute_near(rows, 4, 80)
    assert results(dedup(spark, docs, 2)) == brute_substrings(rows, 50)


def test_carried_columns_come_back(spark):
    docs = spark.createDataFrame([(1, "a b c d e", "x"), (2, "a b c d e", "y"), (3, None, None)], DOCS + ", __mine string")
    got = NearDuplicates(spark, docs, 4, carry=("__mine",)).documents().collect()
    assert sorted((r.doc_id, r.component_id, r["__mine"]) for r in got) == [(1, 1, "x"), (2, 1, "y"), (3, 3, None)]


def test_near_duplicates_at_the_tables_own_size(spark):
    """Every link on sf0.01, by the sets of all pairs that share a shingle few enough texts have."""
    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no tables")
    docs = spark.read.parquet(path).select("doc_id", "text")
    got = {r.doc_id: r.component_id for r in NearDuplicates(spark, docs, 4).documents().collect()}
    assert got == brute_near([tuple(r) for r in docs.collect()], 4, 80)


def test_near_duplicates_of_nothing(spark):
    assert NearDuplicates(spark, spark.createDataFrame([], DOCS), 4).documents().count() == 0
    assert [tuple(r) for r in NearDuplicates(spark, spark.createDataFrame([(1, None)], DOCS), 4).documents().collect()] == [(1, 0, 1, True)]


def test_embeddings(spark, monkeypatch):
    import sparkloom.llm.embeddings as e

    monkeypatch.setattr(e, "BLOCK", 40)  # several tables and blocks
    rng = np.random.default_rng(4)
    rows, i = [], 0
    for label in (0, 1, None):
        for _ in range(12):
            c = rng.standard_normal(16)
            for k in range(int(rng.integers(1, 12))):
                v = c + rng.standard_normal(16) * 0.2
                rows.append((i, [float(x) for x in v.astype(np.float32)], label))
                i += 1
                if k == 3:
                    rows.append((i, rows[-1][1], label))
                    i += 1
    n = i
    odd = [(n, None, 0), (n + 1, [0.0] * 16, 0), (n + 2, [float("nan")] * 16, 0), (n + 3, [None] * 16, 0), (n + 4, [1.0] * 8, 0), (n + 5, [2.0] * 8, 0), (n + 6, [], 0), (n + 7, [float("inf")] + [1.0] * 15, 0)]
    rows += odd
    assert plan(400, 0.93, 0.999)[1] > 1
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, node string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_duplicates(spark, df).collect()}
    ok = [(v, np.array(x, dtype=np.float32).astype(float), y) for v, x, y in rows if y is not None and x and None not in x and np.isfinite(x).all() and any(x)]
    links = {v: 0 for v, _, _ in rows}
    root = {v: v for v in links}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (a, x, l) in enumerate(ok):
        for b, y, m in ok[:k]:
            if l == m and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93:
                links[a] += 1
                links[b] += 1
                p, q = sorted((find(a), find(b)))
                root[q] = p
    found = sum(g[0] for g in got.values())
    assert found >= 0.9 * sum(links.values()) and all(got[v][0] <= links[v] for v in links)
    assert sum(got[v][1] == find(v) for v in links) >= 0.98 * len(links)
    assert all(got[v] == (0, v, True) for v, *_ in odd if v not in (n + 4, n + 5)) and got[n + 5] == (1, n + 4, False)
    assert near_duplicates(spark, df.limit(0)).count() == 0


def test_embeddings_of_doubles(spark, monkeypatch):
    import sparkloom.llm.embeddings as e

    monkeypatch.setattr(e, "BLOCK", 10)
    rng = np.random.default_rng(9)
    base = rng.standard_normal((30, 12))
    rows = []
    for i, v in enumerate(base):
        for k, scale in enumerate((1.0, 1e-200, 1e200, 1e-310)):
            rows.append((i * 10 + k, [float(x) for x in (v + 0.05 * k * rng.standard_normal(12)) * scale], 0))
    rows += [(900, [1e-320] + [0.0] * 11, 0), (901, [0.0, 1e-320] + [0.0] * 10, 0), (902, [1.0] + [0.0] * 11, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_duplicates(spark, df, recall=1.0).collect()}
    x = np.array([r[1] for r in rows])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = (x @ x.T >= 0.93) & ~np.eye(len(x), dtype=bool)
    ids = [r[0] for r in rows]
    assert [got[d][0] for d in ids] == links.sum(axis=1).tolist()
    assert got[900] == (1, 900) and got[901] == (0, 901) and got[902] == (1, 900)


def test_estimates_are_unbiased_and_bounded():
    from sparkloom.llm.embeddings import pair_links, rotation

    rng = np.random.default_rng(0)
    x = rng.standard_normal((300, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    turned = x @ rotation(64, 11).T
    signs = np.where(turned > 0, 1.0, -1.0)
    f = np.abs(turned).sum(axis=1) / 8
    guess = (signs / 8 @ turned.T) / f[:, None]
    off = guess - x @ x.T
    np.fill_diagonal(off, 0)
    assert abs(off.mean()) < 0.01 and (np.abs(off) < 4 * 0.1).mean() > 0.99
    hit = pair_links(x, signs, f, turned, slice(0, 300), slice(0, 300), 0.3)
    exact = x @ x.T >= 0.3
    assert not (hit & ~exact).any() and (hit & exact).sum() >= 0.99 * exact.sum()


def reachable(links, keys):
    """The component of each key, as a set."""
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in links:
        root[find(a)] = find(b)
    out = {}
    for k in keys:
        out.setdefault(find(k), set()).add(k)
    return {k: out[find(k)] for k in keys}


def test_repeated_doc_ids_carry_links_on(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    near = lambda t: t.replace("30", "thirty")
    rows = [(3, a), (5, a), (5, b), (8, b), (9, near(b)), (11, c), (12, c), (12, ""), (13, None), (None, a), (None, c), (20, "x y"), (20, "z w"), (21, "z w")]
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in NearDuplicates(spark, spark.createDataFrame(rows, DOCS)).documents().collect()), key=repr)
    want = [(3, 3, True), (5, 3, False), (5, 3, False), (8, 3, False), (9, 3, False), (11, 11, True), (12, 11, False), (12, 12, True), (13, 13, True), (None, 3, False), (None, 11, False), (20, 20, True), (20, 20, True), (21, 20, False)]
    assert got == sorted(want, key=repr)
    con = duckdb.connect()  # the query's SQL says the same of such rows
    con.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert sorted(con.execute(f"SELECT doc_id, component_id, kept FROM ({minhash.OP7_SQL})").fetchall(), key=repr) == got


def test_vectors_with_null_and_repeated_ids(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((6, 24))
    rows, ids = [], [9, None, 10, None, None, 7, 7, 3, 7, 2, 15, None]
    for i, vec_id in enumerate(ids):
        rows.append((vec_id, [float(x) for x in base[i // 2] + 0.02 * rng.standard_normal(24)], "l"))
    rows += [(None, rows[0][1], "l"), (4, rows[0][1], "l"), (None, None, "l"), (1, [0.0] * 24, "l"), (None, rows[2][1], None)]
    x = [np.array(v) if v and any(v) and label else None for _, v, label in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if x[i] is not None and x[j] is not None and x[i] @ x[j] / np.linalg.norm(x[i]) / np.linalg.norm(x[j]) >= 0.93]
    of = reachable(links, range(len(rows)))
    want = []
    for i, (vec_id, *_) in enumerate(rows):
        known = [rows[j][0] for j in of[i] if rows[j][0] is not None]
        first = min(known) if known else None
        want.append((vec_id, sum(i in p for p in links), first, vec_id == first))
    for recall in (0.999, 1.0):
        got = near_duplicates(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string"), recall=recall)
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("dim", [64, 256])
def test_recall_of_the_buckets(spark, dim):
    """Links at the threshold among more vectors than one block holds, by the buckets of the plan and by the exact way."""
    rng = np.random.default_rng(dim)
    n, pairs = 2600, 500
    x = rng.standard_normal((n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = rng.standard_normal((pairs, dim))
    side -= (side * x[:pairs]).sum(axis=1, keepdims=True) * x[:pairs]
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    x[pairs : 2 * pairs] = 0.931 * x[:pairs] + np.sqrt(1 - 0.931**2) * side
    assert plan(n, 0.93, 0.999)[0] > 0
    vectors = spark.createDataFrame([(i, [float(c) for c in v], "one") for i, v in enumerate(x)], "vec_id long, embedding array<double>, label string")
    got = sum(r.n_links for r in near_duplicates(spark, vectors).collect()) / 2
    assert 0.99 * pairs <= got <= pairs
    assert sum(r.n_links for r in near_duplicates(spark, vectors, recall=1.0).collect()) == 2 * pairs
