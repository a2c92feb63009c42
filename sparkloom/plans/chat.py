"""A chat log to a profile and a card: chunk, extract, verify, merge, serialise."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cards import to_card
from ..operators.chunking import chunk_messages, render_blocks
from ..operators.evidence import verify_evidence
from ..operators.extract import Ledger, fragments
from ..operators.merge import gathered, list_items, merge_lore, ordered_union, scene_tones, style_examples
from ..types import LIST_FIELDS

SYSTEM = (
    "Describe the stable character of {name}, the side marked by that name, from this part of a chat. Answer with one JSON object: "
    "traits, behavior_rules, taboos, humor, memories and uncertainties as arrays of short strings, scene_tone as an object, "
    "lore_candidates as an array of {{title, content, keys}} and evidence as an array of {{quote, message_index}}. "
    "Quotes must be copied word for word. Leave out what the text does not show."
)


BLOCKS = 1 << 24  # block ids of a conversation


def blocks_of(messages: DataFrame, block_size: int = 100, gap_hours: float = 6.0, conversation: str | None = None) -> DataFrame:
    """Messages with block_id and idx; with ``conversation``, a column of numbers, each conversation is cut for itself (and is one task's work at most)."""
    if conversation is None:
        return chunk_messages(messages.withColumn("scope", F.lit(0)), ["scope"], block_size, gap_hours)
    cut = chunk_messages(messages.withColumn("scope", F.col(conversation)), ["scope"], block_size, gap_hours)
    return cut.withColumn("block_id", F.col("scope").cast("bigint") * BLOCKS + F.col("block_id"))


def distill(spark: SparkSession, messages: DataFrame, name: str, factory: Callable, path: str, run_id: str = "run", max_attempts: int = 2, block_size: int = 100, gap_hours: float = 6.0, conversation: str | None = None) -> DataFrame:
    """One row: the merged profile of ``name``. Calling again with the same ``path`` calls only for blocks that are not done."""
    chunked = blocks_of(messages, block_size, gap_hours, conversation)
    rendered = render_blocks(chunked, ["scope"], F.lit(name)).select("block_id", "rendered")
    ledger = Ledger(spark, path)
    ledger.run(rendered, factory, SYSTEM.format(name=name), run_id, max_attempts)
    return merge(ledger, chunked, name)


def merge(ledger: Ledger, chunked: DataFrame, name: str) -> DataFrame:
    """The profile of what the ledger holds."""
    who = [F.lit(name).alias("name")]
    scope = ["name"]
    frags = fragments(ledger.latest()).select(*who, "*")
    out = frags.sparkSession.createDataFrame([(name, "")], "name string, persona_summary string")
    told = frags.select("name", "block_id", F.posexplode("evidence").alias("pos", "e")).select("name", "block_id", "pos", "e.quote", "e.message_index")
    checked = verify_evidence(told, chunked.select("block_id", "idx", "content"), ["block_id"])
    kept = checked.filter("status = 'kept'")
    lore_rows = frags.select("name", "block_id", F.posexplode("lore_candidates").alias("pos", "l")).select("name", "block_id", "pos", "l.*")
    lore, notes = merge_lore(lore_rows, scope)
    for c in LIST_FIELDS:
        items = list_items(frags, c, scope)
        if c == "uncertainties":  # notes come after all that the fragments say
            later = notes.withColumn("block_id", F.col("block_id") + F.lit(1 << 62))
            items = items.unionByName(later)
        out = out.join(gathered(ordered_union(items, scope), scope, c), scope, "left")
    out = out.join(gathered(style_examples(kept, scope), scope, "style_examples"), scope, "left")
    scenes = frags.select("name", "block_id", F.posexplode("scene_tone").alias("pos", "s")).select("name", "block_id", "pos", F.col("s.k").alias("scene"), F.col("s.v").alias("tone"))
    out = out.join(gathered(scene_tones(scenes, scope).withColumn("item", F.struct(F.col("scene").alias("k"), F.col("tone").alias("v"))), scope, "scene_tone"), scope, "left")
    out = out.join(gathered(lore.withColumn("item", F.struct("title", "content", "keys")), scope, "lore"), scope, "left")
    counts = checked.groupBy("name").agg(F.count_if(F.col("status") == "kept").alias("kept"), F.count_if(F.col("status") == "dropped").alias("dropped"))
    stats = ledger.stats().select(F.lit(name).alias("name"), "blocks_done", "blocks_failed", "failed_blocks", "calls")
    out = out.join(counts, scope, "left").join(stats, scope, "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("int")
    out = out.withColumn("evidence_stats", F.create_map(F.lit("verified"), zero("kept"), F.lit("dropped_total"), zero("dropped"), F.lit("blocks_done"), zero("blocks_done"), F.lit("blocks_failed"), zero("blocks_failed")))
    return out.drop("kept", "dropped")


def card(profile: DataFrame, **how) -> DataFrame:
    return to_card(profile, **how)
