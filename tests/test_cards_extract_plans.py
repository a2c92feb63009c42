import io
import json
import urllib.error
from functools import partial

import pytest

from sparkloom.operators import cards, extract, migrate
from sparkloom.plans import chat, novel

PROFILE = "name string, persona_summary string, traits array<string>, behavior_rules array<string>, taboos array<string>, humor array<string>, memories array<string>, uncertainties array<string>, style_examples array<string>, scene_tone array<struct<k:string,v:string>>, lore array<struct<title:string,content:string,keys:string>>, evidence_stats map<string,int>"
ADA = ("Ada", "", [f"t{i}" for i in range(14)], ["r1"], ["x"], [], ["m"], ["u"], ["「a」", "「b」"], [("home", "soft")], [("Sea", "by the sea", "sea  shore")], {"verified": 2})


def test_card_fields_and_round_trip(spark):
    p = spark.createDataFrame([ADA], PROFILE)
    card = json.loads(cards.to_card(p, first_mes="hi").first().card)
    d = card["data"]
    assert (card["spec"], card["spec_version"], d["name"], d["first_mes"]) == ("chara_card_v3", "3.0", "Ada", "hi")
    assert d["personality"] == "、".join(f"t{i}" for i in range(12)) and d["mes_example"] == "「a」\n「b」"
    assert d["description"].split("\n")[0].startswith("Ada，特质：t0、t1") and "t7。习惯" in d["description"]
    assert d["character_book"]["entries"] == [{"id": 0, "keys": ["sea", "shore"], "content": "by the sea", "comment": "Sea", "enabled": True, "insertion_order": 100, "constant": False, "position": "before_char"}]
    back = cards.import_cards(cards.to_card(p).select("card")).first().asDict(recursive=True)
    want = p.first().asDict(recursive=True)
    want["persona_summary"], want["lore"][0]["keys"] = d["description"], "sea shore"  # an empty summary falls back to the description
    assert {k: back[k] for k in want} == want


def test_foreign_cards(spark):
    v2 = {"spec": "chara_card_v2", "data": {"name": " Bo ", "description": "a cook", "personality": "kind，calm、 ", "mes_example": " x \n\ny", "character_book": {"entries": [{"keys": "k1  k2", "content": " c " + "d" * 30}, {"keys": ["z"], "content": "e", "comment": "E"}, {"content": " "}]}}}
    got = cards.from_card(spark.createDataFrame([(json.dumps(v2),)], "card string")).first()
    assert (got.name, got.persona_summary, got.traits, got.style_examples) == ("Bo", "a cook", ["kind", "calm"], ["x", "y"])
    assert [tuple(x) for x in got.lore] == [("c " + "d" * 18, "c " + "d" * 30, "k1 k2"), ("E", "e", "z")]
    flat = cards.from_card(spark.createDataFrame([('{"name": "Cy"}',)], "card string")).first()
    assert flat.name == "Cy" and flat.lore == []
    with pytest.raises(ValueError):
        cards.import_cards(spark.createDataFrame([('{"data": {"name": " "}}',), ("{",)], "card string"))


def test_summary(spark):
    df = spark.createDataFrame([("A", None, [], None), ("B", ["x"], None, ["h"])], "name string, traits array<string>, behavior_rules array<string>, humor array<string>")
    assert [r.s for r in df.orderBy("name").select(cards.merge_summary().alias("s")).collect()] == ["A", "B，特质：x。幽默感：h。"]


class Opener:
    def __init__(self, *answers):
        self.answers, self.calls = list(answers), 0

    def __call__(self, request, timeout):
        self.calls += 1
        a = self.answers.pop(0)
        if isinstance(a, int):
            raise urllib.error.HTTPError("u", a, "x", None, None)
        if isinstance(a, Exception):
            raise a
        return io.BytesIO(json.dumps(a).encode())


def client(opener, waits):
    return extract.HttpClient(extract.ClientConfig("http://h", "k", "m"), opener, waits.append)


def test_http_retries():
    ok = {"choices": [{"message": {"content": "yes"}}], "usage": {"prompt_tokens": 3, "completion_tokens": 4}}
    waits = []
    assert client(Opener(429, 503, ok), waits).chat(0, "s", "u") == extract.ChatResult("yes", 3, 4) and waits == [4.0, 5.0]
    for answers, calls in (((404,), 1), (({"choices": []},), 1), ((500, TimeoutError(), urllib.error.URLError("x")), 3)):
        o = Opener(*answers)
        with pytest.raises(extract.ProviderError):
            client(o, []).chat(0, "s", "u")
        assert o.calls == calls
    with pytest.raises(ValueError):
        extract.ClientConfig("", "k", "m")


def reply(quote, **more):
    return json.dumps({"traits": ["kind"], "evidence": [{"quote": quote, "message_index": 0}]} | more)


def messages(spark, contents):
    return spark.createDataFrame([(i, f"2026-01-01T00:{i:02d}:00", "self", c) for i, c in enumerate(contents)], "ord long, ts string, direction string, content string")


def Factory(replies):  # noqa: N802  a class of the library, so that workers can import it
    return partial(extract.KeyedFake, replies)


def test_run_and_resume(spark, tmp_path):
    m, path = messages(spark, ["tea now", "ok", "cake later", "bye"]), str(tmp_path / "ledger")
    first = chat.distill(spark, m, "Ada", Factory({0: [reply("tea now", lore_candidates=[{"title": "T", "content": "one"}])], 1: ["no", "still no"]}), path, block_size=2).first()
    assert first.evidence_stats == {"verified": 1, "dropped_total": 0, "blocks_done": 1, "blocks_failed": 1}
    assert first.failed_blocks == [1] and first.calls == 3
    good = reply("cake later", traits=["KIND", "calm"], lore_candidates=[{"title": "t", "content": "two"}], uncertainties=["?", "maybe"], scene_tone={"home": "soft"})
    then = chat.distill(spark, m, "Ada", Factory({1: [good]}), path, block_size=2)
    got = then.first()
    assert got.calls == 4 and got.failed_blocks == []
    assert got.traits == ["kind", "calm"] and got.style_examples == ["「tea now」", "「cake later」"]
    assert [x.content for x in got.lore] == ["one"] and got.uncertainties == ["maybe", "lore「t」内容冲突，已保留首见"]
    assert json.loads(chat.card(then).first().card)["data"]["extensions"]["sparkloom"]["scene_tone"] == {"home": "soft"}
    again = chat.distill(spark, m, "Ada", Factory({}), path, block_size=2).first()
    assert again.calls == 4  # nothing left to call for


NOVEL = "Chapter 1\nAnn met Bob. Where are you going, she asked.\nHe said nothing at all.\nChapter 2\nAnn slept well that night.\nBob left the old town."


def novel_reply(names, quotes=(), **more):
    return json.dumps({"characters": [{"name": n, "traits": ["brave", "brave"], "identity": "", "relationships": "friends"} for n in names], "evidence": [{"quote": q, "speaker": s} for q, s in quotes], "memories": ["Ann met Bob", "The end"]} | more)


def test_novel(spark, tmp_path):
    replies = {0: [novel_reply(["Ann", "Bob"], [("Where are you going", "Ann"), ("never in the text", "Ann"), ("nothing at all", None)], lore_candidates=[{"title": "Town", "content": "old", "keys": "t1 t2"}])], 1: [novel_reply(["Ann"], [("left the old town", "Bob")])]}
    got = novel.distill(spark, NOVEL, "Book", Factory(replies), str(tmp_path / "l"), max_characters=2)
    r = got.report.first()
    assert (r.blocks_done, r.blocks_failed, r.characters_found, r.memories, r.lore_entries, r.pending_quotes, r.calls) == (2, 0, 2, 2, 1, 1, 2)
    found = got.cards.collect()
    assert [(c.name, c.mentions, c.quotes, c.traits) for c in found] == [("Ann", 2, ["Where are you going"], ["brave"]), ("Bob", 1, ["left the old town"], ["brave"])]
    assert json.loads(found[0].card)["data"]["character_book"]["entries"] == []
    book = got.worldbook.orderBy("id").collect()
    assert [(b.id, b["keys"], b.insertion_order) for b in book] == [(0, ["Town", "t1", "t2"], 100), (1, ["Ann", "Bob"], 200), (2, ["Book"], 201)]
    novel.write(got, str(tmp_path / "out"), "Book")
    assert len(list((tmp_path / "out" / "Book" / "cards").glob("name=*"))) == 2
    cut = novel.distill(spark, NOVEL, "Book", Factory({0: replies[0]}), str(tmp_path / "m"), max_blocks=1)
    assert cut.report.first().blocks_done == 1


def test_novel_failures(spark, tmp_path):
    path = str(tmp_path / "f")
    with pytest.raises(RuntimeError):
        novel.distill(spark, NOVEL, "B", Factory({0: ["x"], 1: ["y"]}), path)
    part = novel.distill(spark, NOVEL, "B", Factory({0: [novel_reply(["Ann"])], 1: ["y"]}), path).report.first()
    assert (part.blocks_done, part.failed_blocks) == (1, [1])
    whole = novel.distill(spark, NOVEL, "B", Factory({1: [novel_reply(["Bob"])]}), path, retry_blocks=[1]).report.first()
    assert (whole.blocks_done, whole.characters_found) == (2, 2)
    with pytest.raises(ValueError):
        novel.distill(spark, " \n", "B", Factory({}), str(tmp_path / "g"))


def test_migration(spark):
    profile = {"identity": {}, "personality": {"traits": ["kind", {"content": "calm"}], "temperament": "soft"}, "speaking_style": {"tone": ["dry"], "common_phrases": ["hm"]}, "preferences": {"dislikes": ["noise"]}, "behavior_rules": ["be on time", "尊重她的边界：no calls"], "shared_memories": [{"content": "the trip"}, {"x": 1}], "relationship_style": {"comfort_style": "tea"}}
    companions = spark.createDataFrame([("Ada", json.dumps(profile), 2), ("Old", "{}", 1)], "name string, profile_json string, updated_at int")
    lore = spark.createDataFrame([("PLACE", "Sea", "far", '{"evidence": "她：go there", "importance": 0.9}', 1, 2), ("PLACE", "Hill", "near", "broken{", 1, 1), ("X", "off", "z", None, 0, 0)], "category string, title string, content string, payload string, enabled int, updated_at int")
    memories = spark.createDataFrame([("a", "low", 0.1, None), ("a", "high", 0.9, None), ("a", "gone", 1.0, "t"), ("a", " ", 1.0, None)], "memory_type string, content string, importance double, deleted_at string")
    p = migrate.load_profile(companions)
    d = json.loads(migrate.convert(p, lore, memories).first().card)["data"]
    own = d["extensions"]["sparkloom"]
    assert d["name"] == "Ada" and d["first_mes"] == "在呀，我是Ada。" and d["personality"] == "kind、calm"
    assert d["description"].split("\n") == ["Ada——重要关系对象。", "气质：soft。", "说话风格：dry。", "高频口头禅（务必自然穿插）：hm。", "讨厌：noise。", "重要行为准则：be on time"]
    assert own["taboos"] == ["no calls"] and own["behavior_rules"] == ["be on time"] and own["memories"] == ["high", "low", "the trip"] and own["persona_summary"] == "soft。。安慰方式：tea"
    assert [(e["id"], e["comment"], e["insertion_order"]) for e in d["character_book"]["entries"]] == [(0, "Hill", 125), (1, "Sea", 145), (2, "忌讳-noise", 150)]
    assert d["character_book"]["entries"][1]["keys"] == ["Sea", "gothere"]
    assert migrate.load_profile(companions, "Old").first().name == "Old"
    with pytest.raises(LookupError, match="Ada"):
        migrate.load_profile(companions, "None")
    assert migrate.enabled_lore(lore).count() == 2


def test_command_line(spark, tmp_path, capsys):
    from sparkloom.__main__ import main
    from sparkloom.plans.catalogue import steady_client

    (tmp_path / "b.txt").write_text("Anna came home.\nBruno waited for Anna at the old gate.\n", encoding="utf-8")
    main(["--input", str(tmp_path / "b.txt"), "--name", "Gate", "--base-url", "http://none", "--api-key", "k", "--model", "m", "--out", str(tmp_path / "out")], steady_client)
    assert "card " in capsys.readouterr().out
    assert list((tmp_path / "out/Gate/cards").glob("name=*")) and list((tmp_path / "out/Gate/report").glob("*.json"))


def test_cards_by_lines(spark, tmp_path):
    profile = spark.createDataFrame([("Nora", json.dumps({"preferences": {"dislikes": ["x"]}, "shared_memories": [{"content": 'a "lake"'}], "uncertainties": ['"entries":[] "memories":[]']}), 1)], "name string, profile_json string, updated_at long")
    lore = spark.createDataFrame([(c, f"t {i}", text, "{}", 1, i) for i, (c, text) in enumerate([("a", 'say "no",\n'), ("a", " "), (None, "lost"), ("b", ",é")])], "category string, title string, content string, payload string, enabled long, updated_at long")
    told = spark.createDataFrame([("one, two", 0.5, None), (",", 0.9, None)], "content string, importance double, deleted_at string")
    p = migrate.load_profile(profile)
    lines = spark.createDataFrame(migrate.convert_lines(p, lore, told).collect(), "part int, i long, line string")
    card = spark.createDataFrame([tuple(migrate.convert(p, lore, told).first())], "name string, card string")
    assert "".join(r.line for r in lines.orderBy("part", "i").collect()) == card.first().card
    want = cards.from_card(card).first()
    back, found, memories = cards.from_lines(lines)
    assert back.drop("card").first() == cards.from_card(card).select(*back.drop("card").columns).first()
    assert [tuple(r) for r in found.orderBy("i").drop("i").collect()] == [tuple(x) for x in want.lore]
    assert [r.memory for r in memories.orderBy("i").collect()] == want.memories


def test_a_card_over_the_size_of_a_variant(spark, tmp_path):
    from sparkloom.plans import catalogue

    spark.range(280).selectExpr("id AS doc_id", "repeat('ab ', 340000) AS text", "'en' AS lang").write.parquet(str(tmp_path / "documents.parquet"))
    spark.sql("SELECT 1L AS event_id, '{}' AS props, 1.0D AS value").write.parquet(str(tmp_path / "events.parquet"))
    got = catalogue.migrate_convert(spark, str(tmp_path)).first()
    assert (got.name, got.n_lore, got.n_memories, got.last_memory) == ("Nora", 142, 2, "the lake")
