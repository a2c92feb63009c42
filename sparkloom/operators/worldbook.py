"""Books of lore and events shared by a novel's characters, and the characters' cards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import split_words
from .cards import COMMA, NAMESPACE, SEMICOLON, SPEC, SPEC_VERSION, STOP

#: Prefixes and templates of the text, and how many of each part.
LORE_MARK, EVENT_MARK = "[设定] ", "[事件] "
MAX_EVENTS, EVENT_KEYS, CARD_TRAITS, CARD_RELATIONS, CARD_QUOTES, STYLE_QUOTES = 60, 3, 12, 5, 6, 8
UNKNOWN_PERSON = "本书人物"
TEMPLATES = {
    "traits": "性格：", "speaking_style": "说话风格：", "relationships": "人物关系：",
    "closing": ("你正与读者（用户）在《", "》的世界中互动，保持人物的言行逻辑与语言习惯。"),
    "scenario": ("《", "》的世界。用户是穿越进书中世界的读者。"),
    "greeting": ("（", " 注意到你的到来）……你是谁？为何在此？"),
}


def _entry(df: DataFrame, book: str) -> DataFrame:
    return df.select(book, "id", "keys", "content", "comment", "insertion_order")


def _numbered(rows: DataFrame, book: str, first) -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``i``, their places in their book from 0, and the number of each book's rows (__b, __size).

    A row's place is the count of the rows in earlier blocks plus its place in its own
    block, so a window sees one block's rows or one count a block, never a book's texts.
    """
    per = rows.groupBy(F.col(book).alias("__b"), F.col(first[0]).alias("__k")).agg(F.count("*").alias("__n"))
    before = W.partitionBy("__b").orderBy("__k").rowsBetween(W.unboundedPreceding, -1)
    start = per.select("__b", "__k", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    place = F.row_number().over(W.partitionBy(book, first[0]).orderBy(*first)) - 1
    same = F.col(book).eqNullSafe(F.col("__b")) & F.col(first[0]).eqNullSafe(F.col("__k"))
    out = rows.withColumn("i", place).join(start, same).withColumn("i", F.col("i") + F.col("__start")).drop("__b", "__k", "__start")
    return out, per.groupBy("__b").agg(F.sum("__n").alias("__size"))


def worldbook(lore: DataFrame, events: DataFrame, tops: DataFrame, book: str = "book", first=("block_id", "pos")) -> DataFrame:
    """One row per entry: lore (order from 100), then the first 60 events (order from 200), with dense ids.

    ``lore`` (book, block_id, pos, title, content, keys) and ``events`` (book, block_id,
    pos, item) are merged already; ``tops`` (book, name, rank) are the main characters,
    whose names in an event are its keys, or else the book's.
    """
    order = W.partitionBy(book).orderBy(*first)
    said, sizes = _numbered(lore, book, first)
    said = said.withColumn("keys", F.concat(F.array("title"), split_words("keys"))).withColumn("comment", F.col("title")).withColumn("content", F.concat(F.lit(LORE_MARK), F.col("title"), F.lit("："), F.col("content")))
    said = said.withColumn("id", F.col("i")).withColumn("insertion_order", F.lit(100) + F.col("i"))
    names = tops.groupBy(book).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda x: x["name"]).alias("names"))
    # a plain comparison with the row number, which Spark turns into a limit before the shuffle
    told = events.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= MAX_EVENTS).withColumn("i", F.col("n") - 1).join(names, book, "left")
    hit = F.slice(F.filter(F.coalesce("names", F.array().cast("array<string>")), lambda n: F.contains(F.col("item"), n)), 1, EVENT_KEYS)
    told = told.withColumn("keys", F.when(F.size(hit) > 0, hit).otherwise(F.array(F.col(book).cast("string")))).withColumn("comment", F.substring("item", 1, 16)).withColumn("content", F.concat(F.lit(EVENT_MARK), F.col("item")))
    told = told.join(sizes, F.col(book).eqNullSafe(F.col("__b")), "left").withColumn("id", F.coalesce("__size", F.lit(0)) + F.col("i")).withColumn("insertion_order", F.lit(200) + F.col("i"))
    both = _entry(said, book).unionByName(_entry(told, book))
    return both.select(book, F.col("id").cast("int").alias("id"), "keys", "content", "comment", F.lit(True).alias("enabled"), F.col("insertion_order").cast("int").alias("insertion_order"), F.lit(False).alias("constant"), F.lit("before_char").alias("position"))


def novel_cards(characters: DataFrame, book: str = "book", namespace: str = NAMESPACE) -> DataFrame:
    """Rows (book, name, mentions, identity, speaking_style, traits, relationships, quotes) with the card's fields and its JSON; its own book stays empty."""
    full = lambda c: F.coalesce(c, F.lit("")) != ""
    title = F.col(book).cast("string")
    first = F.concat("name", F.lit("——"), F.when(full("identity"), F.col("identity")).otherwise(F.lit(UNKNOWN_PERSON)), F.lit(STOP))
    listed = lambda c, n, sep: F.array_join(F.slice(c, 1, n), sep)
    lines = [
        first,
        F.when(F.size("traits") > 0, F.concat(F.lit(TEMPLATES["traits"]), listed("traits", CARD_TRAITS, COMMA), F.lit(STOP))),
        F.when(full("speaking_style"), F.concat(F.lit(TEMPLATES["speaking_style"]), "speaking_style", F.lit(STOP))),
        F.when(F.size("relationships") > 0, F.concat(F.lit(TEMPLATES["relationships"]), listed("relationships", CARD_RELATIONS, SEMICOLON), F.lit(STOP))),
        F.concat(F.lit(TEMPLATES["closing"][0]), title, F.lit(TEMPLATES["closing"][1])),
    ]
    c = characters.withColumn("persona_summary", first).withColumn("description", F.concat_ws("\n", *lines)).withColumn("personality", listed("traits", CARD_TRAITS, COMMA))
    c = c.withColumn("scenario", F.concat(F.lit(TEMPLATES["scenario"][0]), title, F.lit(TEMPLATES["scenario"][1]))).withColumn("first_mes", F.concat(F.lit(TEMPLATES["greeting"][0]), "name", F.lit(TEMPLATES["greeting"][1])))
    c = c.withColumn("mes_example", F.array_join(F.transform(F.slice("quotes", 1, CARD_QUOTES), lambda q: F.concat(F.lit("「"), q, F.lit("」"))), "\n")).withColumn("style_examples", F.slice("quotes", 1, STYLE_QUOTES))
    own = F.struct(F.lit(1).alias("version"), F.concat(F.lit("novel:"), title).alias("source"), "persona_summary", "traits", "style_examples", F.create_map(F.lit("mention_count"), F.col("mentions").cast("int")).alias("evidence_stats"))
    none = F.array().cast("array<string>")
    data = F.struct("name", "description", "personality", "scenario", "first_mes", "mes_example", F.lit("").alias("creator_notes"), F.lit("").alias("system_prompt"), F.lit("").alias("post_history_instructions"), none.alias("alternate_greetings"), F.struct(none.alias("entries")).alias("character_book"), F.array(F.lit(namespace), F.lit("novel"), title).alias("tags"), F.struct(own.alias(namespace)).alias("extensions"))
    return c.withColumn("card", F.to_json(F.struct(F.lit(SPEC).alias("spec"), F.lit(SPEC_VERSION).alias("spec_version"), data.alias("data"))))
