"""The catalogue's queries over all pairs, all lines and whole texts, against brute force."""

import itertools

import pytest

from sparkloom.operators import similarity
from sparkloom.plans import catalogue


def stored(spark, path, name, rows, schema):
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{path}/{name}.parquet")


def listed(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("limit", [similarity.QUERY_CHARS, 12])
def test_jaccard_of_every_pair(spark, tmp_path, monkeypatch, limit):
    monkeypatch.setattr(similarity.jaccard_pairs, "__defaults__", (limit,))
    monkeypatch.setattr(similarity, "PAIRS", 7)
    texts = [(1, 0, "the cat sat"), (1, 1, None), (2, 0, ""), (2, 1, "x"), (2, 1, "the cat  sat"), (3, 0, "écoute 😀😀 et nage"), (3, 1, " \n ")]
    items = [(0, "the hat"), (0, "the hat"), (41, "écoute"), (99, "x"), (120, ""), (121, None), (7, "😀 😀"), (None, "cat")]
    stored(spark, tmp_path, "conversations", [(*r, "user") for r in texts], "conv_id long, turn int, text string, role string")
    stored(spark, tmp_path, "benchmark", items, "item_id long, text string")

    def share(a, b):
        if a is None or b is None:
            return 0.0
        a, b = ("".join(x.split()) for x in (a, b))
        x, y = ({s[i : i + 2] for i in range(len(s) - 1)} or {s} for s in (a, b))
        return round(len(x & y) / len(x | y), 6) if a or b else 0.0

    want = [(c, t, i, share(q, x)) for (c, t, x), (i, q) in itertools.product(texts, items)]
    assert listed(catalogue.queries()["bigram_jaccard"](spark, str(tmp_path)).select("conv_id", "turn", "item_id", "jaccard")) == sorted(want, key=repr)


BOOK = [
    (1, "The gate is old\nAnna saw the gate\nBruno ran off\nthe gate is OLD!", "en", "a"),
    (2, "Anna sat here\nBruno ran off\nThe gate is gone", "en", "a"),
    (3, "Bruno spoke\n\n  a third line \nfourth line of it", "fr", "a"),
    (4, "Bruno again\na third line", "fr", "a"),
    (5, "single line", "fr", "b"),
    (6, None, "fr", "b"),
]
DOCUMENTS = "doc_id long, text string, lang string, source string"


def book_lines():
    return [(s, d, i, x) for d, t, _, s in BOOK for i, x in enumerate(y.strip() for y in (t or "").split("\n") if y.strip())]


def norm(x):
    return "".join(c for c in x.lower() if c.isalnum())


def test_every_line_is_a_quote(spark, tmp_path):
    stored(spark, tmp_path, "documents", BOOK, DOCUMENTS)
    got = listed(catalogue.queries()["quote_attribution"](spark, str(tmp_path)).select("source", "block_id", "pos", "quote", "speaker", "attributed"))
    # the next block's first name; Anna and Bruno are known from block 1 on, The is too
    speaker, want, seen = {1: "Anna", 2: "Bruno", 3: "Bruno", 4: None, 5: None}, [], set()
    for s, d, i, x in book_lines():
        who = speaker[d]
        if who is None or (who, x) not in seen:
            want.append((s, d, i, x, who, who is not None))
        seen.add((who, x))
    assert got == sorted(want, key=repr) and {x[2] for x in got} == {0, 1, 2, 3}


def test_every_line_is_lore_and_an_event(spark, tmp_path):
    stored(spark, tmp_path, "documents", BOOK, DOCUMENTS)
    rows = catalogue.queries()["worldbook_entries"](spark, str(tmp_path)).collect()
    for source in "ab":
        lore, events = {}, {}
        for s, _, _, x in book_lines():
            if s == source:
                lore.setdefault(norm(x.split(" ")[0]), x)
                events.setdefault(norm(x), x)
        want = [f"[设定] {x.split(' ')[0]}：{x}" for x in lore.values()] + [f"[事件] {x}" for x in events.values()]
        mine = sorted((r for r in rows if r.source == source), key=lambda r: r.id)
        assert [r.content for r in mine] == want
        assert [r["keys"].split("|") for r in mine[: len(lore)]] == [[x.split(" ")[0], *x.split()] for x in lore.values()]


def test_texts_are_taken_whole(spark, tmp_path):
    long = [f"one two {d} " + " ".join(f"w{i}" for i in range(30)) + f" end{d}" for d in range(3)]
    stored(spark, tmp_path, "documents", [(d, t + "\n" + t[::-1], "en", "a") for d, t in enumerate(long)], DOCUMENTS)
    stored(spark, tmp_path, "conversations", [(1, d, t, "user") for d, t in enumerate(long)], "conv_id long, turn int, text string, role string")
    stored(spark, tmp_path, "benchmark", [(1, "a-word-of-over-twelve-characters " * 3 + "late words"), (2, "ab: cd")], "item_id long, text string")
    run = lambda name, *cols: listed(catalogue.queries()[name](spark, str(tmp_path)).select(*cols))
    assert run("scene_first_wins", "scene", "tone") == [("en", long[0] + "\n" + long[0][::-1])]
    assert run("lore_words", "block_id", "pos", "n_keys") == [(d, i, 34) for d in range(3) for i in range(2)]
    assert run("flatten_items", "turn", "items") == [(d, "user|" + t) for d, t in enumerate(long)]
    assert run("split_keys", "item_id", "keys") == [(1, "late|words|awordofov"), (2, "ab:|cd|abcd")]
    assert run("migrate_lore", "i", "content") == [(0, f"[en] one two：{long[1]}\n{long[1][::-1]}")]


def test_worldbook_numbers_by_block(spark):
    """Places run on over the blocks of a book; null books and blocks count, events follow the lore."""
    from sparkloom.operators.worldbook import worldbook

    keys = [(b, k, p) for b in ("hot", "small", None) for k in (None, 0, 2, 7) for p in range(1 if b == "small" else 9)]
    lore = spark.createDataFrame([(b, k, p, f"t{k}.{p}", "c", "") for b, k, p in keys], "book string, block_id long, pos int, title string, content string, keys string")
    told = [("hot", 0, p, f"e{p}") for p in range(70)] + [("none", 3, 0, "alone"), (None, 1, 0, "lost")]
    events = spark.createDataFrame(told, "book string, block_id long, pos int, item string")
    tops = spark.createDataFrame([], "book string, name string, rank int")
    got = {}
    for r in worldbook(lore, events, tops).collect():
        got.setdefault(r.book, []).append((r.id, r.insertion_order, r.comment))
    for book in ("hot", "small", None, "none"):
        own = sorted((k for k in keys if k[0] == book), key=lambda k: (k[1] is not None, k[1] or 0, k[2]))
        want = [(i, 100 + i, f"t{k}.{p}") for i, (_, k, p) in enumerate(own)]
        want += [(len(own) + i, 200 + i, t[3]) for i, t in enumerate([t for t in told if t[0] == book][:60])]
        assert sorted(got[book]) == want
    empty = worldbook(lore.limit(0), events.limit(0), tops)
    assert empty.count() == 0


def test_a_novel_reads_its_replies_once(spark):
    """Whatever parts the report has: once for them all, and once or twice for its numbers."""
    import json

    from sparkloom.operators import extract
    from sparkloom.plans import novel

    seen, n = spark.sparkContext.accumulator(0), 10
    reply = json.dumps({"characters": [{"name": "Ada", "traits": ["calm"], "identity": ""}], "memories": ["a day"], "lore_candidates": [{"title": "Inn", "content": "An inn", "keys": "inn"}], "evidence": [{"quote": "a long day", "message_index": 0, "speaker": "Ada"}]})
    told = spark.createDataFrame([("r", 0, i, "done", 0, "", 1, 10, 5, reply) for i in range(n)], extract.LEDGER)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    class Once:
        def rows(self):
            return told.mapInArrow(counted, told.schema)

        def latest(self):
            return extract.latest(self.rows())

    pieces = spark.createDataFrame([("b", i, 0, "it was a long day") for i in range(n)], "book string, block_id long, idx int, content string")
    report = novel.merge(Once(), pieces, "b").report
    report_plan = report._jdf.queryExecution().optimizedPlan().toString()
    report = report.first()
    assert (report.characters_found, report.memories, report.lore_entries, report.blocks_done) == (1, 1, 1, n)
    assert seen.value <= 3 * n
    assert "variant_get" not in report_plan  # what is counted was parsed before, not for each part
