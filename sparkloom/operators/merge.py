"""Deterministic merges: the first occurrence in (block, position) order wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col, normalize, strip_u


def first_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row per ``keys`` in ``order``: a minimum, so rows combine before the shuffle and no group is sorted."""
    rest = [c for c in df.columns if c not in keys]
    lead = [*order, *(c for c in rest if c not in order)]
    won = df.groupBy(*keys).agg(F.min(F.struct(*lead)).alias("__won"))
    return won.select(*keys, *(F.col("__won")[c].alias(c) for c in rest))


def ordered_union(items: DataFrame, scope: list[str], item="item", order=("block_id", "pos"), compose: bool = True) -> DataFrame:
    """Items once each, compared normalised, in their first spelling; blank ones dropped.

    The shuffle carries 128 bits of a normalised item instead of the item a second time.
    """
    keyed = items.withColumn("__key", normalize(item, compose)).filter("__key <> ''").withColumn("__key", F.unhex(F.md5("__key")))
    return first_by(keyed, [*scope, "__key"], list(order)).drop("__key")


def exact_union(items: DataFrame, scope: list[str], item="item", order=("block_id", "pos")) -> DataFrame:
    """Items once each, compared as they are."""
    return first_by(items, [*scope, item], list(order))


def scene_tones(scenes: DataFrame, scope: list[str]) -> DataFrame:
    """The first tone of each scene (exact name), from rows (scope, block_id, pos, scene, tone)."""
    return first_by(scenes, [*scope, "scene"], ["block_id", "pos"])


def lore_key(title, content, compose: bool = True) -> Column:
    key = normalize(title, compose)
    return F.when(key != "", key).otherwise(F.substring(normalize(content, compose), 1, 40))


#: Fixed value: the note on entries that contradict the first one.
CONFLICT = ("lore「", "」内容冲突，已保留首见")


def merge_lore(lore: DataFrame, scope: list[str], compose: bool = True) -> tuple[DataFrame, DataFrame]:
    """First entry per title key, and the notes on later entries of other content.

    ``lore`` has (scope, block_id, pos, title, content, keys). Notes come in the
    order of the contradicting entries.
    """
    text = normalize("content", compose)
    keyed = lore.withColumn("__key", F.unhex(F.md5(lore_key("title", "content", compose)))).withColumn("__text", F.unhex(F.md5(text)))
    first = first_by(keyed, [*scope, "__key"], ["block_id", "pos"])
    # texts are compared by 128 bits, and notes need no more of a row than its title
    small = keyed.select(*scope, "block_id", "pos", "title", "__key", "__text")
    won = first_by(small, [*scope, "__key"], ["block_id", "pos"]).select(*scope, "__key", F.col("__text").alias("__first"))
    note = F.concat(F.lit(CONFLICT[0]), F.col("title"), F.lit(CONFLICT[1]))
    notes = small.join(won, [*scope, "__key"]).filter("__text <> __first").select(*scope, "block_id", "pos", note.alias("item"))
    return first.drop("__key", "__text"), notes


def style_examples(evidence: DataFrame, scope: list[str], per_block: int = 2) -> DataFrame:
    """The first quotes of each block in corner brackets, once each, from kept rows (scope, block_id, pos, quote)."""
    from pyspark.sql import Window as W

    place = F.row_number().over(W.partitionBy(*scope, "block_id").orderBy("pos"))
    few = evidence.withColumn("__n", place).filter(F.col("__n") <= per_block)
    return exact_union(few.select(*scope, "block_id", "pos", F.concat(F.lit("「"), F.col("quote"), F.lit("」")).alias("item")), scope)


def gathered(items: DataFrame, scope: list[str], name: str, item="item", order=("block_id", "pos")) -> DataFrame:
    """One row per scope with its items in order, for the final document of a profile."""
    pair = F.struct(*order, F.col(item).alias("__item"))
    return items.groupBy(*scope).agg(F.transform(F.array_sort(F.collect_list(pair)), lambda x: x["__item"]).alias(name))


def merge_characters(mentions: DataFrame, scope: list[str]) -> DataFrame:
    """Per name: mentions, place of the first one, first non-empty identity and speaking_style.

    ``mentions`` has (scope, block_id, pos, name, identity, speaking_style).
    """
    at = F.struct("block_id", "pos")
    first = lambda c: F.min(F.when(F.coalesce(F.col(c), F.lit("")) != "", F.struct("block_id", "pos", F.col(c).alias("v"))))["v"]
    named = mentions.withColumn("name", strip_u("name")).filter("name <> ''")
    return named.groupBy(*scope, "name").agg(F.count("*").alias("mentions"), F.min(at)["block_id"].alias("first_block"), F.min(at)["pos"].alias("first_pos"), F.coalesce(first("identity"), F.lit("")).alias("identity"), F.coalesce(first("speaking_style"), F.lit("")).alias("speaking_style"))


def top_characters(characters: DataFrame, scope: list[str], n: int = 5) -> DataFrame:
    """The ``n`` most mentioned, earlier ones first among equals, with their rank."""
    from pyspark.sql import Window as W

    rank = F.row_number().over(W.partitionBy(*scope).orderBy(F.desc("mentions"), "first_block", "first_pos", "name"))
    return characters.withColumn("rank", rank).filter(F.col("rank") <= n)


def attribute_quotes(quotes: DataFrame, characters: DataFrame, scope: list[str]) -> tuple[DataFrame, DataFrame]:
    """Verified quotes (scope, block_id, pos, quote, speaker): per speaker known by that block, once each; and the pending rest."""
    known = characters.select(*scope, F.col("name").alias("speaker"), "first_block")
    said = quotes.withColumn("speaker", F.nullif(strip_u("speaker"), F.lit(""))).join(known, [*scope, "speaker"], "left")
    own = F.coalesce(F.col("first_block") <= F.col("block_id"), F.lit(False))
    mine = exact_union(said.filter(own).select(*scope, "speaker", "block_id", "pos", F.col("quote").alias("item")), [*scope, "speaker"])
    return mine.withColumnRenamed("item", "quote"), said.filter(~own).select(*scope, "block_id", "pos", "quote", "speaker")


def list_items(fragments: DataFrame, field: str, scope: list[str]) -> DataFrame:
    """Rows (scope, block_id, pos, item) of an array column."""
    return fragments.select(*scope, "block_id", F.posexplode(col(field)).alias("pos", "item"))


#: The labels of a character's line.
PROFILE_LABELS = {"identity": ("（", "）："), "style": "；风格：", "relations": "；关系：", "nobody": "?"}


def _quoted(c: Column) -> Column:
    """A string in the quotes that Python would print it in."""
    return F.when(F.contains(c, F.lit("'")) & ~F.contains(c, F.lit('"')), F.concat(F.lit('"'), c, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("\\'")), F.lit("'")))


def character_profile_text(characters) -> Column:
    """One line for each of an array of characters (name, identity, traits, speaking_style, relationships)."""

    def line(c: Column) -> Column:
        text = lambda f: F.coalesce(c[f], F.lit(""))
        some = lambda f: F.coalesce(c[f], F.array().cast("array<string>"))
        known = F.when(F.size(some("relationships")) > 0, F.concat(F.lit(PROFILE_LABELS["relations"] + "["), F.array_join(F.transform(some("relationships"), _quoted), ", "), F.lit("]"))).otherwise("")
        opened, closed = PROFILE_LABELS["identity"]
        return F.concat(F.coalesce(c["name"], F.lit(PROFILE_LABELS["nobody"])), F.lit(opened), text("identity"), F.lit(closed), F.array_join(some("traits"), "、"), F.lit(PROFILE_LABELS["style"]), text("speaking_style"), known)

    return F.array_join(F.transform(characters if isinstance(characters, Column) else F.col(characters), line), "\n")
