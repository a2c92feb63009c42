"""World-Info: which entries of a book a conversation calls up, turn by turn.

``messages`` (conv, turn, text) are taken in order of turn; ``entries`` have entry_id, keys
and content, and whatever of the following a step reads: ``constant``, ``second`` and
``logic``, ``probability``, ``sticky``, ``cooldown``, ``delay``, ``exempt``, ``priority``,
``cost``, ``pool`` and ``weight``. The steps, each a table to a table:

scan -> timed -> recursed -> one_of_each_pool -> within_budget

Keys go out in blocks of bounded size (``contained``), and what is read of entries is joined as a table, however
large. A step's work grows with what the step before left, and none makes a row for each message and
entry but for constant entries, which are in every turn.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..plans.scratch import written
from .evidence import contained

#: How the second keys of an entry count once one of its keys is there.
LOGIC = ("and_any", "and_all", "not_any", "not_all")


def chance(*parts) -> Column:
    """A number from 0 to 2**32 - 1 drawn by a hash of ``parts``: the same in every run."""
    told = F.concat_ws(":", *(F.col(p).cast("string") if isinstance(p, str) else p for p in parts))
    return F.conv(F.substring(F.md5(told.cast("binary")), 1, 8), 16, 10).cast("bigint")


def placed(messages: DataFrame) -> DataFrame:
    """``messages`` with ``place``, their number in the conversation from 0, and ``size``, how many it has."""
    own = W.partitionBy("conv")
    return messages.withColumn("place", F.row_number().over(own.orderBy("turn")).cast("long") - 1).withColumn("size", F.count("*").over(own))


def scan(messages: DataFrame, entries: DataFrame, depth: int) -> DataFrame:
    """(conv, place, entry_id): where one of an entry's keys is in the last ``depth`` messages and its second keys allow it.

    Keys are found anywhere in a text, whatever the case. Each key is looked up once a message, and a
    find counts for the ``depth`` places from there on. Constant entries are called up everywhere.
    """
    m = placed(messages)
    key = lambda c, kind: entries.select("entry_id", F.lit(kind).alias("second"), F.explode(F.array_distinct(F.transform(c, F.lower))).alias("key")).filter("key <> ''")
    keys = key("keys", False).unionByName(key("second", True))
    texts = m.select(F.struct("conv", "place", "size").alias("at"), F.lower("text").alias("t"))
    found = contained(texts, keys.select(F.col("key").alias("b"), F.col("key").alias("q")).distinct()).join(keys, F.col("b") == F.col("key"))
    spread = F.sequence(F.col("a.place"), F.least(F.col("a.place") + depth, F.col("a.size")) - 1)
    seen = found.filter(F.lit(depth > 0)).select("a.conv", F.explode(spread).alias("place"), "entry_id", "second", "key")
    seen = seen.groupBy("conv", "place", "entry_id").agg(F.bool_or(~F.col("second")).alias("first"), F.count_distinct(F.when(F.col("second"), F.col("key"))).alias("n"))
    rule = entries.select("entry_id", "logic", F.size(F.array_distinct(F.filter(F.transform(F.coalesce("second", F.array().cast("array<string>")), F.lower), lambda k: k != ""))).alias("of"))
    allowed = F.when(F.col("of") == 0, True).when(F.col("logic") == "and_all", F.col("n") == F.col("of")).when(F.col("logic") == "not_any", F.col("n") == 0).when(F.col("logic") == "not_all", F.col("n") < F.col("of")).otherwise(F.col("n") > 0)
    called = seen.filter("first").join(rule, "entry_id").filter(allowed).select("conv", "place", "entry_id")
    constant = entries.filter("constant").agg(F.collect_set("entry_id").alias("ids"))  # one row
    always = m.select("conv", "place").join(F.broadcast(constant), F.lit(True)).select("conv", "place", F.explode("ids").alias("entry_id"))
    return called.unionByName(always).distinct()


def stepwise(df: DataFrame, keys: list[str], order: list[str], start: Callable[[], object], result: str) -> DataFrame:
    """``df`` with a decision a row (``result``, a boolean) that depends on those before it of the same ``keys``.

    ``start`` makes the state of a group, whose ``step(row)`` decides; rows are dictionaries. Groups stream
    through sorted partitions, so only a group's state is in memory; one group is in order and so one task's work.
    """
    out = T.StructType([*df.schema.fields, T.StructField(result, T.BooleanType())])
    schema = to_arrow_schema(out)

    def run(batches):
        at, state = None, None
        for b in batches:
            decided = []
            for row in b.to_pylist():
                own = tuple(row[k] for k in keys)
                if state is None or own != at:
                    at, state = own, start()
                decided.append(state.step(row))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(decided, pa.bool_())], schema=schema)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, out)


class Effects:
    """An entry of a conversation: called up anew only after it has ended and its pause is over."""

    def __init__(self):
        self.free = 0

    def step(self, row: dict) -> bool:
        if row["place"] < self.free or row["place"] + 1 < (row["delay"] or 0):
            return False
        self.free = row["place"] + 1 + (row["sticky"] or 0) + (row["cooldown"] or 0)
        return True


def timed(called: DataFrame, entries: DataFrame, messages: DataFrame) -> DataFrame:
    """(conv, place, entry_id, begun): where entries are active, and the place at which that began.

    An entry called up stays for ``sticky`` more messages and then cannot be called for ``cooldown`` messages; before the
    ``delay``-th message it cannot be called at all. Each call that would begin anew takes effect with
    ``probability`` percent (null: always); while an entry stays, nothing is drawn.
    """
    rule = entries.select("entry_id", "sticky", "cooldown", "delay", F.coalesce("probability", F.lit(100)).alias("p"))
    drawn = called.join(rule, "entry_id").filter(chance("conv", "entry_id", "place") < F.col("p") * (1 << 32) / 100)
    begun = stepwise(drawn.select("conv", "entry_id", "place", "sticky", "cooldown", "delay"), ["conv", "entry_id"], ["place"], Effects, "begins").filter("begins")
    size = messages.groupBy("conv").agg(F.count("*").alias("size"))
    stays = F.sequence(F.col("place"), F.least(F.col("place") + F.coalesce("sticky", F.lit(0)), F.col("size") - 1))
    return begun.join(size, "conv").select("conv", F.explode(stays).alias("at"), "entry_id", F.col("place").alias("begun")).withColumnRenamed("at", "place")


def reach(entries: DataFrame, steps: int, cut: Callable[[DataFrame, str], DataFrame] = written) -> DataFrame:
    """(entry_id, other, level): entries that the content of others calls up, in at most ``steps`` steps; the least number of each.

    An entry that is ``exempt`` is not called up this way; nor is one with second keys, which are for messages.
    """
    open_ = entries.filter(~F.coalesce("exempt", F.lit(False)) & (F.size(F.coalesce("second", F.array().cast("array<string>"))) == 0))
    keys = open_.select(F.col("entry_id").alias("other"), F.explode(F.array_distinct(F.transform("keys", F.lower))).alias("key")).filter("key <> ''")
    found = contained(entries.select(F.col("entry_id").alias("at"), F.lower("content").alias("t")), keys.select(F.col("key").alias("b"), F.col("key").alias("q")).distinct())
    edges = cut(found.join(keys, F.col("b") == F.col("key")).select(F.col("a").alias("entry_id"), "other").filter("entry_id <> other").distinct(), "edges")
    known = edges.withColumn("level", F.lit(1))
    front = known
    hop = edges.select(F.col("entry_id").alias("via"), F.col("other").alias("next"))
    for level in range(2, steps + 1):
        new = front.join(hop, F.col("other") == F.col("via")).select("entry_id", F.col("next").alias("other")).filter("entry_id <> other").distinct()
        front = cut(new.join(known, ["entry_id", "other"], "left_anti").withColumn("level", F.lit(level)), "front")
        known = known.unionByName(front)
    return known if steps > 0 else known.limit(0)


def recursed(active: DataFrame, entries: DataFrame, steps: int, cut: Callable[[DataFrame, str], DataFrame] = written) -> DataFrame:
    """(conv, place, entry_id, level): ``active`` at level 0, and what they call up at the least number of steps.

    Which entries call up which does not depend on the conversation, so it is followed once (``reach``). An entry brings
    its lists of others, one a level, to the turn, and a turn puts its lists together: its rows are as many as its
    entries, not as the ways by which they are reached, and they are dealt by turns, so that a constant
    entry, which is in all of them, is no task's load.
    """
    of = [f"__{level}" for level in range(1, steps + 1)]
    lists = [F.collect_list(F.when(F.col("level") == i + 1, F.col("other"))).alias(c) for i, c in enumerate(of)]
    turns = active.select("conv", "place", "entry_id").repartition("conv", "place")
    if lists:
        turns = turns.join(reach(entries, steps, cut).groupBy("entry_id").agg(*lists), "entry_id", "left")
    turns = turns.groupBy("conv", "place").agg(F.collect_set("entry_id").alias("__0"), *(F.flatten(F.collect_list(c)).alias(c) for c in of))
    for i, c in enumerate(of):
        turns = turns.withColumn(c, F.array_except(c, F.concat("__0", *of[:i])))  # each once
    at = lambda level: lambda x: F.struct(x.alias("entry_id"), F.lit(level).alias("level"))
    found = F.concat(*(F.transform(c, at(level)) for level, c in enumerate(["__0", *of])))
    return turns.select("conv", "place", F.explode(found).alias("e")).select("conv", "place", "e.*")


def one_of_each_pool(active: DataFrame, entries: DataFrame) -> DataFrame:
    """``active`` with one entry of each ``pool`` and turn, drawn by ``weight`` (null or under 1: 1); entries of no pool stay.

    The draw is by a hash of conversation, place and entry: the least -ln(u) / weight wins, which each entry
    is with a probability in proportion to its weight, and in every run the same one.
    """
    of = active.join(entries.select("entry_id", "pool", F.greatest(F.coalesce("weight", F.lit(1)), F.lit(1)).alias("__w")), "entry_id")
    u = (chance("conv", "place", "entry_id") + 1) / F.lit(float((1 << 32) + 1))
    draw = F.struct((-F.log(u) / F.col("__w")).alias("d"), "entry_id")
    best = of.filter("pool IS NOT NULL").groupBy("conv", "place", "pool").agg(F.min(draw)["entry_id"].alias("entry_id"))
    won = of.join(best.drop("pool"), ["conv", "place", "entry_id"], "left_semi")
    return of.filter("pool IS NULL").unionByName(won).select(*active.columns)


def within_budget(active: DataFrame, entries: DataFrame, budget: int) -> DataFrame:
    """(conv, place, entry_id, rank, spent): each turn's entries in order of importance, up to the first that does not fit.

    Constant entries come first, then those of higher ``priority``, then those that messages called up before
    those that entries did, then those of smaller ids. ``spent`` is the cost with this one.
    """
    of = active.join(entries.select("entry_id", "constant", "priority", "cost"), "entry_id")
    order = W.partitionBy("conv", "place").orderBy(F.coalesce("constant", F.lit(False)).desc(), F.desc_nulls_last("priority"), F.col("level") > 0, "entry_id")
    spent = F.sum(F.coalesce(F.col("cost").cast("long"), F.lit(0))).over(order.rowsBetween(W.unboundedPreceding, 0))
    return of.withColumn("rank", F.row_number().over(order)).withColumn("spent", spent).filter(F.col("spent") <= budget).select("conv", "place", "entry_id", "rank", "spent")


def activate(messages: DataFrame, entries: DataFrame, depth: int = 4, steps: int = 2, budget: int = 4000) -> DataFrame:
    """All steps: what goes into the context of each turn, in order."""
    active = timed(scan(messages, entries, depth), entries, messages)
    return within_budget(one_of_each_pool(recursed(active, entries, steps), entries), entries, budget)


class Guard:
    """What one sender may start on its own: a few times a day, with a pause in between."""

    def __init__(self, per_day: int, pause: int):
        self.per_day, self.pause = per_day, pause
        self.day, self.sent, self.last = None, 0, None

    def step(self, row: dict) -> bool:
        if row["day"] != self.day:
            self.day, self.sent = row["day"], 0
        if not row["open"] or self.sent >= self.per_day or (self.last is not None and row["us"] - self.last < self.pause):
            return False
        self.sent, self.last = self.sent + 1, row["us"]
        return True


def guarded(wishes: DataFrame, keys: list[str], ts: str, order: str, per_day: int, pause_minutes: float, hours: tuple[int, int], probability: int = 100) -> DataFrame:
    """``wishes`` with ``sent``: those that pass the guards, in order of time.

    A wish is sent between the two ``hours`` of the day (UTC; from the first to before the second, over midnight where
    that is smaller), with ``probability`` percent, if fewer than ``per_day`` were sent that day and the last
    one, of whatever day, is ``pause_minutes`` ago. What is not sent counts for nothing. A null time is never sent.
    """
    a, z = hours
    hour = F.hour(F.col(ts))
    inside = (hour >= a) & (hour < z) if a <= z else (hour >= a) | (hour < z)
    lucky = chance(*keys, order) < probability * (1 << 32) / 100
    w = wishes.withColumn("us", F.unix_micros(F.col(ts).cast("timestamp"))).withColumn("day", F.to_date(F.col(ts))).withColumn("open", F.coalesce(inside & lucky, F.lit(False)))
    limit = int(pause_minutes * 60_000_000)

    def start() -> Guard:
        return Guard(per_day, limit)

    decided = stepwise(w.select(*keys, order, "us", "day", "open"), keys, ["us", order], start, "sent").select(*keys, order, "sent")
    same = [F.col(f"w.{c}").eqNullSafe(F.col(f"d.{c}")) for c in (*keys, order)]
    return wishes.alias("w").join(decided.alias("d"), same).select("w.*", "d.sent")
