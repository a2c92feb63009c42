"""Profiles to character cards (V3 JSON) and cards back to profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import LINE_END, col, drop_blank, split_words, strip_u

#: Fixed values of the card format, and the labels of its text.
SPEC, SPEC_VERSION = "chara_card_v3", "3.0"
COMMA, SEMICOLON, STOP = "、", "；", "。"
SUMMARY = {"traits": "特质：", "behavior_rules": "习惯：", "humor": "幽默感："}
DESCRIPTION = {"traits": "性格特质：", "behavior_rules": "行为习惯："}
NAMESPACE = "sparkloom"
ENTRY = "array<struct<id:int,keys:array<string>,content:string,comment:string,enabled:boolean,insertion_order:int,constant:boolean,position:string>>"


def _list(c) -> Column:
    return F.coalesce(col(c), F.array().cast("array<string>"))


def merge_summary(name="name", traits="traits", rules="behavior_rules", humor="humor") -> Column:
    """The name with up to 8 traits, 5 rules and 3 kinds of humour; the name alone without any."""
    parts = [
        F.when(F.size(_list(c)) > 0, F.concat(F.lit(label), F.array_join(F.slice(_list(c), 1, n), sep)))
        for c, label, n, sep in ((traits, SUMMARY["traits"], 8, COMMA), (rules, SUMMARY["behavior_rules"], 5, SEMICOLON), (humor, SUMMARY["humor"], 3, SEMICOLON))
    ]
    text = F.concat_ws(STOP, *parts)
    return F.when(text == "", col(name)).otherwise(F.concat(col(name), F.lit("，"), text, F.lit(STOP)))


def book_entries(lore="lore") -> Column:
    """Lore as book entries: ids from 0, order from 100, keys split at white space."""
    return F.transform(
        F.coalesce(col(lore), F.array().cast("array<struct<title:string,content:string,keys:string>>")),
        lambda x, i: F.struct(
            i.cast("int").alias("id"), split_words(x["keys"]).alias("keys"), x["content"].alias("content"), F.coalesce(x["title"], F.lit("")).alias("comment"),
            F.lit(True).alias("enabled"), (F.lit(100) + i).cast("int").alias("insertion_order"), F.lit(False).alias("constant"), F.lit("before_char").alias("position"),
        ),
    )


def card_fields(profiles: DataFrame) -> DataFrame:
    """``profiles`` with description, personality, mes_example and entries."""
    summary = F.when(F.coalesce(F.col("persona_summary"), F.lit("")) != "", F.col("persona_summary")).otherwise(merge_summary())
    lines = [summary, *(F.when(F.size(_list(c)) > 0, F.concat(F.lit(DESCRIPTION[c]), F.array_join(_list(c), sep))) for c, sep in (("traits", COMMA), ("behavior_rules", SEMICOLON)))]
    return (
        profiles.withColumn("description", F.concat_ws("\n", *lines))
        .withColumn("personality", F.array_join(F.slice(_list("traits"), 1, 12), COMMA))
        .withColumn("mes_example", F.array_join(_list("style_examples"), "\n"))
        .withColumn("entries", book_entries())
    )


LISTS = ("traits", "behavior_rules", "taboos", "humor", "memories", "uncertainties", "style_examples")


def to_card(profiles: DataFrame, namespace: str = NAMESPACE, first_mes: str = "", notes: str = "") -> DataFrame:
    """name and card (V3 JSON text). Full lists, uncertainties too, go under the extension ``namespace``."""
    p = card_fields(profiles)
    empty = F.array().cast("array<string>")
    own = F.struct(
        F.lit(1).alias("version"), F.coalesce("persona_summary", F.lit("")).alias("persona_summary"), *(_list(c).alias(c) for c in LISTS),
        F.map_from_entries(F.coalesce("scene_tone", F.array().cast("array<struct<k:string,v:string>>"))).alias("scene_tone"), F.coalesce("evidence_stats", F.create_map().cast("map<string,int>")).alias("evidence_stats"),
    )
    data = F.struct(
        "name", "description", "personality", F.lit("").alias("scenario"), F.lit(first_mes).alias("first_mes"), "mes_example", F.lit(notes).alias("creator_notes"), F.lit("").alias("system_prompt"), F.lit("").alias("post_history_instructions"),
        empty.alias("alternate_greetings"), F.struct("entries").alias("character_book"), F.array(F.lit(namespace)).alias("tags"), F.struct(own.alias(namespace)).alias("extensions"),
    )
    return p.select("name", F.to_json(F.struct(F.lit(SPEC).alias("spec"), F.lit(SPEC_VERSION).alias("spec_version"), data.alias("data"))).alias("card"))


def split_listed(c) -> Column:
    """Parts between (ideographic or full-width) commas, blank ones dropped, otherwise as they are."""
    return drop_blank(F.split(F.translate(F.coalesce(col(c), F.lit("")), "，", COMMA), COMMA))


def split_examples(c) -> Column:
    return drop_blank(F.transform(F.split(F.coalesce(col(c), F.lit("")), LINE_END), strip_u))


def lore_of(e: Column) -> Column:
    """The lore (title, content, keys) of a book entry, a VARIANT."""
    content = strip_u(F.coalesce(F.try_variant_get(e, "$.content", "string"), F.lit("")))
    comment = F.coalesce(F.try_variant_get(e, "$.comment", "string"), F.lit(""))
    keys = F.try_variant_get(e, "$.keys", "array<string>")
    joined = F.when(F.schema_of_variant(F.try_variant_get(e, "$.keys", "variant")) == "STRING", F.array_join(split_words(F.try_variant_get(e, "$.keys", "string")), " ")).otherwise(F.coalesce(F.array_join(keys, " "), F.lit("")))
    return F.struct(F.when(comment != "", comment).otherwise(F.substring(content, 1, 20)).alias("title"), content.alias("content"), joined.alias("keys"))


def from_card(cards: DataFrame, card="card", namespace: str = NAMESPACE) -> DataFrame:
    """``cards`` with the profile's columns. Any V2, V3 or flat card; a null name marks one that cannot be imported."""
    v = F.try_parse_json(col(card))
    df = cards.withColumn("__v", v).withColumn("__d", F.coalesce(F.try_variant_get("__v", "$.data", "variant"), F.col("__v")))
    own = f"$.extensions.{namespace}."
    text = lambda path: F.coalesce(F.try_variant_get("__d", path, "string"), F.lit(""))
    strings = lambda path: F.coalesce(F.try_variant_get("__d", path, "array<string>"), F.array().cast("array<string>"))
    either = lambda a, b: F.when(F.size(a) > 0, a).otherwise(b)
    summary = text(own + "persona_summary")
    entries = F.coalesce(F.try_variant_get("__d", "$.character_book.entries", "array<variant>"), F.array().cast("array<variant>"))

    out = df.withColumn("name", F.nullif(strip_u(text("$.name")), F.lit("")))
    out = out.withColumn("persona_summary", F.when(summary != "", summary).otherwise(text("$.description")))
    out = out.withColumn("traits", either(strings(own + "traits"), split_listed(text("$.personality"))))
    for c in ("behavior_rules", "taboos", "humor", "memories", "uncertainties"):
        out = out.withColumn(c, strings(own + c))
    out = out.withColumn("style_examples", either(strings(own + "style_examples"), split_examples(text("$.mes_example"))))
    out = out.withColumn("scene_tone", F.coalesce(F.map_entries(F.try_variant_get("__d", own + "scene_tone", "map<string,string>")), F.array().cast("array<struct<key:string,value:string>>")).cast("array<struct<k:string,v:string>>"))
    out = out.withColumn("evidence_stats", F.coalesce(F.try_variant_get("__d", own + "evidence_stats", "map<string,int>"), F.create_map().cast("map<string,int>")))
    out = out.withColumn("lore", F.filter(F.transform(entries, lore_of), lambda x: x["content"] != ""))
    return out.drop("__v", "__d")


def from_lines(lines: DataFrame, namespace: str = NAMESPACE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(profile, lore, memories) of a card that comes as lines (``migrate.convert_lines``), of any size.

    The profile is as in ``from_card`` but for its lore and memories, which are rows: (i, title, content, keys)
    and (i, memory). Only the lines around them are put together.
    """
    around = lines.filter("part IN (0, 2, 4)").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "line"))), lambda x: x["line"]), "").alias("card"))  # three rows
    one = F.try_parse_json(F.ltrim("line", F.lit(",")))
    lore = lines.filter("part = 1").select("i", one.alias("v")).select("i", lore_of(F.col("v")).alias("e")).select("i", "e.*").filter("content <> ''")
    memories = lines.filter("part = 3").select("i", F.try_variant_get(one, "$", "string").alias("memory"))
    return from_card(around, namespace=namespace).drop("lore", "memories"), lore, memories


def import_cards(cards: DataFrame, card="card", namespace: str = NAMESPACE) -> DataFrame:
    """As ``from_card``; raises ValueError if a card has no name."""
    out = from_card(cards, card, namespace)
    if n := out.filter("name IS NULL").count():
        raise ValueError(f"{n} cards without a name")
    return out
