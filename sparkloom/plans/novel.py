"""A novel to the cards of its main characters and one shared book."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize
from ..operators.chunking import chunk_novels, render_blocks
from ..operators.evidence import verify_in_blocks
from ..operators.extract import Ledger, characters, fragments, latest, run_stats
from ..operators.merge import attribute_quotes, exact_union, first_by, gathered, merge_characters, ordered_union, top_characters
from ..operators.worldbook import novel_cards, worldbook
from .scratch import written

SYSTEM = (
    "From this part of a novel give one JSON object: characters as an array of {name, identity, traits, speaking_style, relationships}, "
    "lore_candidates as an array of {title, content, keys}, memories as an array of events in one sentence each, and evidence as an array of "
    "{quote, message_index, speaker}, where speaker is null if it is not certain. Quotes must be copied word for word. Use this part only."
)
MIN_QUOTE = 4


@dataclass
class Novel:
    """What a run gives: cards and book entries as tables, and a one-row report."""

    cards: DataFrame
    worldbook: DataFrame
    pending_quotes: DataFrame
    report: DataFrame


def distill(spark: SparkSession, text: str, book: str, factory: Callable, path: str, max_characters: int = 5, max_blocks: int = 0, chunk_chars: int = 3000, run_id: str = "run", retry_blocks: list[int] | None = None) -> Novel:
    """One call per block that is not done (or of ``retry_blocks``). ValueError without text, RuntimeError if all blocks failed."""
    books = spark.createDataFrame([(book, text)], "book string, text string")
    pieces = chunk_novels(books, "book", chunk_chars=chunk_chars)
    if max_blocks > 0:
        pieces = pieces.filter(F.col("block_id") < max_blocks)
    pieces = written(pieces, "pieces")
    if pieces.isEmpty():
        raise ValueError(f"{book}: there is no text to work on")
    rendered = render_blocks(pieces, ["book"]).select("block_id", "rendered")
    ledger = Ledger(spark, path)
    only = spark.createDataFrame([(b,) for b in retry_blocks], "block_id int") if retry_blocks is not None else None
    ledger.run(rendered, factory, SYSTEM, run_id, 1, only)
    state = ledger.latest()
    if state.filter("status = 'done'").isEmpty():
        raise RuntimeError(f"{book}: all {state.count()} blocks failed")
    return merge(ledger, pieces, book, max_characters)


def merge(ledger: Ledger, pieces: DataFrame, book: str, max_characters: int = 5) -> Novel:
    scope = ["book"]
    # replies are gathered once and parsed once, whatever is made of them
    state = written(latest(ledger.rows().select("block_id", "seq", "status", "reply")), "latest")
    said = written(characters(state).select(F.lit(book).alias("book"), "*"), "characters")
    people = merge_characters(said, scope)
    tops = top_characters(people, scope, max_characters)
    frags = written(fragments(state).select(F.lit(book).alias("book"), "*"), "fragments")
    told = frags.select("book", "block_id", F.posexplode("evidence").alias("pos", "e")).select("book", "block_id", "pos", "e.*")
    kept = verify_in_blocks(told, pieces.select("block_id", "idx", "content"), ["block_id"], min_chars=MIN_QUOTE).filter("kept")
    mine, pending = attribute_quotes(kept, people, scope)
    lore = frags.select("book", "block_id", F.posexplode("lore_candidates").alias("pos", "l")).select("book", "block_id", "pos", "l.*").withColumn("__key", normalize("title")).filter("__key <> ''")
    lore = first_by(lore, ["book", "__key"], ["block_id", "pos"]).drop("__key")
    events = ordered_union(frags.select("book", "block_id", F.posexplode("memories").alias("pos", "item")), scope)
    by = ["book", "name"]
    # a character's traits in order of block, place in the block, and place in the list
    listed = said.select("book", "name", "block_id", F.col("pos").alias("p"), F.posexplode("traits").alias("q", "item")).withColumn("pos", F.struct("p", "q"))
    traits = gathered(exact_union(listed.select("book", "name", "block_id", "pos", "item"), by), by, "traits")
    relations = gathered(exact_union(said.filter("relationships <> ''").select("book", "name", "block_id", "pos", F.col("relationships").alias("item")), by), by, "relationships")
    quotes = gathered(mine.select("book", F.col("speaker").alias("name"), "block_id", "pos", F.col("quote").alias("item")), by, "quotes")
    none = F.array().cast("array<string>")
    full = tops
    for part, c in ((traits, "traits"), (relations, "relationships"), (quotes, "quotes")):
        full = full.join(part, by, "left").withColumn(c, F.coalesce(c, none))
    cards = novel_cards(full).orderBy("rank")
    report = run_stats(ledger.rows()).select(F.lit(book).alias("book"), "*")
    for part, c in ((people, "characters_found"), (events, "memories"), (lore, "lore_entries"), (pending, "pending_quotes")):
        report = report.join(F.broadcast(part.agg(F.count("*").alias(c))), F.lit(True))  # one row each
    return Novel(cards, worldbook(lore, events, tops), pending, report)


def write(novel: Novel, path: str, book: str) -> None:
    """Card JSON by name, the book's entries and the report under ``path``/``book``."""
    base = f"{path.rstrip('/')}/{book}"
    novel.cards.select("name", F.col("card").alias("value")).write.partitionBy("name").mode("overwrite").text(f"{base}/cards")
    novel.worldbook.coalesce(1).write.mode("overwrite").json(f"{base}/worldbook")
    novel.report.coalesce(1).write.mode("overwrite").json(f"{base}/report")
