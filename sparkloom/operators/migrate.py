"""Cards from another application's tables: profiles, lore and memories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import first_truthy, flatten_items, is_blank, split_keys
from .cards import COMMA, NAMESPACE, SEMICOLON, SPEC, SPEC_VERSION, STOP
from .chunking import numbered

#: The mark of a boundary among the rules, labels of the text, and how many of each part.
BOUNDARY, BOUNDARY_MARK = "尊重她的边界", "尊重她的边界："
LABELS = {
    "temperament": "气质：", "tone": "说话风格：", "punctuation_style": "标点习惯：", "common_phrases": "高频口头禅（务必自然穿插）：", "nicknames": "对用户的称呼：",
    "likes": "喜欢：", "dislikes": "讨厌：", "rule": "重要行为准则：", "affection_style": "表达爱意：", "comfort_style": "安慰方式：", "conflict_style": "冲突风格：",
}
RELATION = "重要关系对象"
TABOO = ("[TABOO] ", "讨厌/忌讳：", "忌讳-")
GREETING = ("在呀，我是", "。")
ORIGINAL = ("（原话：", "）")
CAPS = {"tone": 5, "common_phrases": 30, "nicknames": 10, "likes": 15, "dislikes": 15, "traits": 20, "style_examples": 24, "taboo_entries": 40}


def load_profile(companions: DataFrame, name: str | None = None) -> DataFrame:
    """(name, profile) of the named companion, or of the last updated one; LookupError names those there are."""
    rows = companions.filter(F.col("name") == name) if name else companions.orderBy(F.desc("updated_at")).limit(1)
    rows = rows.limit(1)
    if rows.isEmpty():
        raise LookupError(f"no companion {name!r}; there are {[r[0] for r in companions.select('name').limit(50).collect()]}")
    return rows.select("name", F.try_parse_json("profile_json").alias("profile"))


def enabled_lore(lore: DataFrame) -> DataFrame:
    return lore.filter(F.col("enabled") == 1).orderBy("updated_at")


def live_memories(memories: DataFrame) -> DataFrame:
    return memories.filter(F.col("deleted_at").isNull() & F.col("content").isNotNull() & (F.trim("content") != "")).orderBy(F.desc("importance"))


def lore_entries(lore: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Book entries (part 0) of enabled lore in order of updated_at, numbered per ``by``: i, keys, content, comment, insertion_order, category."""
    p = F.try_parse_json(F.coalesce("payload", F.lit("{}")))
    evidence = F.coalesce(F.try_variant_get(p, "$.evidence", "string"), F.lit(""))
    weight = F.coalesce(F.try_variant_get(p, "$.importance", "double"), F.lit(0.5))
    rows = numbered(lore.filter(F.col("enabled") == 1), list(by), ["updated_at", "title"])
    text = F.concat(F.lit("["), "category", F.lit("] "), "title", F.lit("："), "content", F.when(evidence != "", F.concat(F.lit(ORIGINAL[0]), evidence, F.lit(ORIGINAL[1]))).otherwise(""))
    return rows.select(*by, F.lit(0).alias("part"), F.col("i").cast("int").alias("i"), split_keys("title", evidence).alias("keys"), text.alias("content"), F.col("title").alias("comment"), (100 + F.floor(weight * 50)).cast("int").alias("insertion_order"), "category")


def _strings(v: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, path, "array<string>"), F.array().cast("array<string>"))


def _flat(v: Column, path: str) -> Column:
    return flatten_items(F.try_variant_get(v, path, "variant"))


def profile_lists(profiles: DataFrame) -> DataFrame:
    """``profiles`` (name, profile) with its lists and texts as columns."""
    v = F.col("profile")
    text = lambda path: F.coalesce(F.try_variant_get(v, path, "string"), F.lit(""))
    rules = _strings(v, "$.behavior_rules")
    out = profiles.select(
        "*", _flat(v, "$.personality.traits").alias("traits"), _flat(v, "$.user_addressing.nicknames_for_user").alias("nicknames"), _flat(v, "$.preferences.likes").alias("likes"), _flat(v, "$.preferences.dislikes").alias("dislikes"),
        _flat(v, "$.uncertainties").alias("uncertainties"), F.filter(rules, lambda r: ~r.startswith(BOUNDARY)).alias("behavior_rules"), F.transform(F.filter(rules, lambda r: r.startswith(BOUNDARY)), lambda r: F.replace(r, F.lit(BOUNDARY_MARK), F.lit(""))).alias("taboos"),
        _strings(v, "$.speaking_style.tone").alias("tone"), _strings(v, "$.speaking_style.common_phrases").alias("common_phrases"), text("$.speaking_style.punctuation_style").alias("punctuation_style"), text("$.personality.temperament").alias("temperament"),
        first_truthy(F.try_variant_get(v, "$.identity.relationship_to_user", "string"), F.lit(RELATION)).alias("relation"), *(text(f"$.relationship_style.{c}").alias(c) for c in ("affection_style", "comfort_style", "conflict_style")),
        F.filter(F.transform(F.coalesce(F.try_variant_get(v, "$.shared_memories", "array<variant>"), F.array().cast("array<variant>")), lambda m: F.try_variant_get(m, "$.content", "string")), lambda m: m.isNotNull() & ~is_blank(m)).alias("shared"),
    )
    part = lambda c, sep: F.when(F.size(c) > 0, F.concat(F.lit(LABELS[c]), F.array_join(F.slice(c, 1, CAPS[c]), sep), F.lit(STOP)))
    one = lambda c: F.when(F.col(c) != "", F.concat(F.lit(LABELS[c]), F.col(c), F.lit(STOP)))
    lines = [F.concat("name", F.lit("——"), "relation", F.lit(STOP)), one("temperament"), part("tone", SEMICOLON), one("punctuation_style"), part("common_phrases", COMMA), part("nicknames", COMMA), part("likes", COMMA), part("dislikes", COMMA), F.when(F.size("behavior_rules") > 0, F.concat(F.lit(LABELS["rule"]), F.get("behavior_rules", F.lit(0))))]
    styled = lambda c: F.when(F.col(c) != "", F.concat(F.lit(LABELS[c]), F.col(c))).otherwise("")
    summary = F.regexp_replace(F.concat_ws(STOP, "temperament", *(styled(c) for c in ("affection_style", "comfort_style", "conflict_style"))), f"^[{STOP} ]+|[{STOP} ]+$", "")
    return out.withColumn("description", F.concat_ws("\n", *lines)).withColumn("persona_summary", summary)


def entries(profiles: DataFrame, lore: DataFrame) -> DataFrame:
    """All book entries of a profile, lore first and then up to 40 dislikes, with dense ids."""
    listed = profile_lists(profiles).select("name", F.posexplode(F.slice("dislikes", 1, CAPS["taboo_entries"])).alias("i", "d"))
    taboo = listed.select(F.lit(1).alias("part"), "i", split_keys("d", F.lit("")).alias("keys"), F.concat(F.lit(TABOO[0]), "name", F.lit(TABOO[1]), "d").alias("content"), F.concat(F.lit(TABOO[2]), F.substring("d", 1, 12)).alias("comment"), F.lit(150).alias("insertion_order"), F.lit("TABOO").alias("category"))
    told = lore_entries(lore)
    size = told.agg(F.count("*").alias("size"))  # one row
    taboo = taboo.join(F.broadcast(size), F.lit(True)).withColumn("i", (F.col("i") + F.col("size")).cast("int")).drop("size")
    return told.unionByName(taboo).withColumnRenamed("i", "id").drop("part")


def memory_rows(profiles: DataFrame, memories: DataFrame) -> DataFrame:
    """(i, content) of all memories of a profile: the table's by falling importance, then those that it shares."""
    live = live_memories(memories).select("importance", "content")
    told = numbered(live, [], [F.col("importance").isNull(), -F.col("importance"), "content"]).select("i", "content")
    size = told.agg(F.count("*").alias("size"))  # one row
    shared = profile_lists(profiles).select(F.posexplode("shared").alias("i", "content")).join(F.broadcast(size), F.lit(True))
    return told.unionByName(shared.select((F.col("i") + F.col("size")).alias("i"), "content"))


def _card(rows: DataFrame, namespace: str, n_entries: Column, n_memories: Column) -> DataFrame:
    """name and card (V3 JSON text) of rows with the profile's lists, entries and memories."""
    none = F.array().cast("array<string>")
    own = F.struct(
        F.lit(1).alias("version"), "persona_summary", "traits", "behavior_rules", "taboos", none.alias("humor"), "memories", "uncertainties", F.slice("common_phrases", 1, CAPS["style_examples"]).alias("style_examples"),
        F.create_map(F.lit("lore_entries"), n_entries, F.lit("memories"), n_memories).alias("evidence_stats"),
    )
    data = F.struct(
        "name", "description", F.array_join(F.slice("traits", 1, CAPS["traits"]), COMMA).alias("personality"), F.lit("").alias("scenario"), F.concat(F.lit(GREETING[0]), "name", F.lit(GREETING[1])).alias("first_mes"), F.lit("").alias("mes_example"),
        F.lit("").alias("creator_notes"), F.lit("").alias("system_prompt"), F.lit("").alias("post_history_instructions"), none.alias("alternate_greetings"), F.struct("entries").alias("character_book"), F.array(F.lit(namespace), F.lit("migration")).alias("tags"), F.struct(own.alias(namespace)).alias("extensions"),
    )
    return rows.select("name", F.to_json(F.struct(F.lit(SPEC).alias("spec"), F.lit(SPEC_VERSION).alias("spec_version"), data.alias("data"))).alias("card"))


def _entry() -> Column:
    """An entry as the card has it."""
    return F.struct("id", "keys", "content", "comment", F.lit(True).alias("enabled"), "insertion_order", F.lit(False).alias("constant"), F.lit("before_char").alias("position"), F.struct("category").alias("extensions"))


def convert(profiles: DataFrame, lore: DataFrame, memories: DataFrame, namespace: str = NAMESPACE) -> DataFrame:
    """name and card (V3 JSON text) of one profile with its lore and memories.

    A card is one document of one person, with all its entries in it, and so one row, which must fit into memory;
    ``convert_lines`` gives the same text as lines, of any size.
    """
    book = entries(profiles, lore).agg(F.array_sort(F.collect_list(_entry())).alias("entries"))
    told = memory_rows(profiles, memories).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "content"))), lambda x: x["content"]).alias("memories"))
    # single rows each
    return _card(profile_lists(profiles).join(book, F.lit(True)).join(told, F.lit(True)), namespace, F.size("entries"), F.size("memories"))


def convert_lines(profiles: DataFrame, lore: DataFrame, memories: DataFrame, namespace: str = NAMESPACE) -> DataFrame:
    """(part, i, line): the card of ``convert`` as lines, which in order of part and i, one after the other, are its text.

    Each entry (part 1) and each memory (part 3) is a line; the parts around them are one line each. ``cards.from_lines`` reads them.
    """
    book, told = entries(profiles, lore), memory_rows(profiles, memories)
    sizes = [df.agg(F.count("*").cast("int").alias(c)) for df, c in ((book, "n_entries"), (told, "n_memories"))]  # one row each
    head = profile_lists(profiles)
    for n in sizes:
        head = head.join(F.broadcast(n), F.lit(True))
    none = F.array().cast("array<string>")
    card = _card(head.withColumn("entries", none).withColumn("memories", none), namespace, F.col("n_entries"), F.col("n_memories"))
    # within a JSON string quotes are escaped, so these are the two lists themselves
    texts = card.select(F.posexplode(F.split("card", r'(?<="entries":\[|"memories":\[)(?=\])')).alias("at", "line")).select((F.col("at") * 2).alias("part"), F.lit(0).cast("long").alias("i"), "line")
    comma = F.when(F.col("i") > 0, ",").otherwise("")
    listed = book.select(F.lit(1).alias("part"), F.col("id").cast("long").alias("i"), F.to_json(_entry()).alias("line"))
    one = F.to_json(F.array("content"))  # in brackets
    listed = listed.unionByName(told.select(F.lit(3).alias("part"), F.col("i").cast("long").alias("i"), one.substr(F.lit(2), F.length(one) - 2).alias("line")))
    return texts.unionByName(listed.withColumn("line", F.concat(comma, "line")))
