import random

from pyspark.sql import functions as F

from sparkloom.functions import text as t
from sparkloom.operators import evidence as e
from sparkloom.operators import merge as m


def one(spark, col, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return df.select(col.alias("x")).first().x


def test_normalize(spark):
    for raw, want in {"Ｈｅ said: “Hi”!": "hesaidhi", "  ，。": "", "ﬁne 1": "fine1", "ÀÉ": "àé", None: None}.items():
        assert one(spark, t.normalize("s"), s=raw) == want


def test_strip_and_clean(spark):
    assert one(spark, t.strip_u("s"), s="　 a b \t") == "a b"
    assert one(spark, t.clean_text("s"), s=" a \r\n\n　\nb") == "a\nb"


def test_jaccard(spark):
    def model(q, c):
        g = lambda s: {s[i : i + 2] for i in range(max(len(s) - 1, 0))} or {s}
        a, b = (g("".join(x for x in s if not x.isspace())) for s in (q, c))
        return 0.0 if a == b == {""} else len(a & b) / len(a | b)

    rng = random.Random(1)
    pairs = [("".join(rng.choice("ab c") for _ in range(rng.randrange(8))), "".join(rng.choice("abc ") for _ in range(rng.randrange(8)))) for _ in range(200)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, q string, c string").select("i", t.bigram_jaccard("q", "c").alias("x"))
    for r in df.collect():
        assert abs(r.x - model(*pairs[r.i])) < 1e-12, pairs[r.i]


def test_json(spark):
    for raw, want in {'```json\n{"k": 1}\n```': "1", 'noise {"k": 2} more': "2", "none": None, "{broken": None, "{a} {b}": None, "[1]": None, "": None, None: None}.items():
        assert one(spark, F.try_variant_get(t.extract_json("s"), "$.k", "string"), s=raw) == want


def test_entities_and_items(spark):
    assert one(spark, t.entity_text(F.parse_json("s")), s='["a",{"text":"b"},{"_text":"c","text":"x"},{"_text":""},5]') == "abc"
    assert one(spark, t.entity_text(F.parse_json("s")), s='"[plain"') == "[plain"
    assert one(spark, t.entity_text(F.parse_json("s")), s="7") == ""
    assert one(spark, t.flatten_items(F.parse_json("s")), s='[" a ",{"content":"b"},{"content":""},"",3]') == ["a", "b"]


def test_split_keys(spark):
    assert one(spark, t.split_keys("a", "b"), a="生日，礼物 手链", b="她：喜欢银色！") == ["生日", "礼物", "手链", "喜欢银色"]
    assert one(spark, t.split_keys("a", "b"), a="，", b=None) == ["，"]
    assert one(spark, t.split_keys("a", "b"), a="abcdefghijklmno", b="") == ["abcdefghijkl"]


def test_verify_evidence(spark, rows):
    messages = spark.createDataFrame([(0, 0, "I like Tea, always."), (0, 1, "and Cake"), (1, 0, "other")], "block_id int, idx int, content string")
    quotes = spark.createDataFrame([
        (1, 0, "like tea", "0"), (2, 0, "made up words", "0"), (3, 0, "cake", "9"), (4, 0, "x", "0"), (5, 0, "cake", None), (6, 0, "always and", "1"), (7, 0, "!!", "0"), (8, 0, "CAKE", "x1"), (9, 7, "tea", "0"), (10, 0, None, "0"), (11, 0, "cake", "1"),
    ], "q int, block_id int, quote string, message_index string")
    got = rows(e.verify_evidence(quotes, messages, ["block_id"]), "q", "status", "kept_index")
    kept = {1: 0, 3: 0, 5: 0, 6: 0, 8: 0, 11: 1}
    assert got == sorted([(q, "kept" if q in kept else "dropped", kept.get(q)) for q in range(1, 12)], key=repr)


def test_find_quotes_in_small_sets(spark, rows):
    texts = spark.createDataFrame([(1, "The quick-brown fox"), (2, None), (3, "Ｑuick"), (4, "")], "doc_id long, text string")
    quotes = spark.createDataFrame([(10, "QUICK"), (11, "brown fox"), (12, "..."), (13, "quick"), (14, None)], "item_id long, text string")
    want = [(1, 10), (1, 11), (1, 13), (3, 10), (3, 13)]
    assert rows(e.find_quotes(texts, quotes, "doc_id", "item_id")) == want
    assert rows(e.find_quotes(texts, quotes, "doc_id", "item_id", limit=6)) == want
    assert rows(e.find_quotes(texts, quotes.limit(0), "doc_id", "item_id")) == []


def test_ordered_union(spark, rows):
    items = spark.createDataFrame([("p", 1, 0, "Kind!"), ("p", 0, 1, "kind"), ("p", 0, 0, "Calm"), ("p", 2, 0, "？"), ("q", 0, 0, "KIND")], "name string, block_id int, pos int, item string")
    u = m.ordered_union(items, ["name"])
    assert rows(u, "name", "block_id", "pos", "item") == [("p", 0, 0, "Calm"), ("p", 0, 1, "kind"), ("q", 0, 0, "KIND")]
    assert {r.name: r.traits for r in m.gathered(u, ["name"], "traits").collect()} == {"p": ["Calm", "kind"], "q": ["KIND"]}


def test_lore(spark, rows):
    lore = spark.createDataFrame([("p", 0, 0, "Home", "by the sea", ""), ("p", 1, 0, "home!", "By the sea.", ""), ("p", 2, 0, "HOME", "in the hills", ""), ("p", 2, 1, "?", "no title", "k")], "name string, block_id int, pos int, title string, content string, keys string")
    first, notes = m.merge_lore(lore, ["name"])
    assert rows(first, "title", "content") == [("?", "no title"), ("Home", "by the sea")]
    assert rows(notes, "block_id", "item") == [(2, "lore「HOME」内容冲突，已保留首见")]


def test_scenes_and_examples(spark, rows):
    s = spark.createDataFrame([("p", 1, 0, "home", "loud"), ("p", 0, 1, "home", "soft"), ("p", 0, 0, "Home", "dry")], "name string, block_id int, pos int, scene string, tone string")
    assert rows(m.scene_tones(s, ["name"]), "scene", "tone") == [("Home", "dry"), ("home", "soft")]
    q = spark.createDataFrame([("p", 0, i, x) for i, x in enumerate(["a", "b", "c"])] + [("p", 1, 0, "b"), ("p", 1, 1, "d")], "name string, block_id int, pos int, quote string")
    assert m.gathered(m.style_examples(q, ["name"]), ["name"], "s").first().s == ["「a」", "「b」", "「d」"]


def test_characters(spark, rows):
    said = spark.createDataFrame([("b", 0, 0, "Ann", "", "calm"), ("b", 0, 1, "Bob", "cook", ""), ("b", 1, 0, " Ann ", "nurse", "loud"), ("b", 1, 1, "", "x", ""), ("b", 2, 0, "Cid", "", None), ("b", 2, 1, "Bob", "", "slow")], "book string, block_id int, pos int, name string, identity string, speaking_style string")
    people = m.merge_characters(said, ["book"])
    assert rows(people, "name", "mentions", "first_block", "identity", "speaking_style") == [("Ann", 2, 0, "nurse", "calm"), ("Bob", 2, 0, "cook", "slow"), ("Cid", 1, 2, "", "")]
    assert [r.name for r in m.top_characters(people, ["book"], 2).orderBy("rank").collect()] == ["Ann", "Bob"]
    quotes = spark.createDataFrame([("b", 0, 0, "q1", "Cid"), ("b", 2, 0, "q2", "Cid"), ("b", 3, 0, "q2", "Cid"), ("b", 1, 0, "q3", None), ("b", 1, 1, "q4", "Zed")], "book string, block_id int, pos int, quote string, speaker string")
    mine, pending = m.attribute_quotes(quotes, people, ["book"])
    assert rows(mine, "speaker", "block_id", "quote") == [("Cid", 2, "q2")]
    assert rows(pending, "quote", "speaker") == [("q1", "Cid"), ("q3", None), ("q4", "Zed")]
