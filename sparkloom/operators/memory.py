"""Four-layer memory: adds folded into a state, scored on recall, kept in a store that is a log of events.

State rows are one per (profile_id, owner, layer, content). Every private read and
write names both profile_id and owner.
"""

from __future__ import annotations

import json
import uuid
import warnings
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import bigram_jaccard, col, is_blank, strip_u
from ..functions.timestamps import days_between, parse_ts
from ..types import LAYERS, MEMORY_STATE

#: Days until half is forgotten, and where raw and episodic memories are archived.
HALF_LIFE = {"raw": 30.0, "episodic": 14.0, "semantic": 3650.0, "core": 3650.0}
ARCHIVE_BELOW = 0.05
FADING = ("raw", "episodic")
SCOPE = ("profile_id", "owner")
KEY = (*SCOPE, "layer", "content")


def half_life(layer="layer") -> Column:
    pairs = [x for k, v in HALF_LIFE.items() for x in (F.lit(k), F.lit(v))]
    return F.element_at(F.create_map(*pairs), col(layer))


def check_adds(adds: DataFrame) -> None:
    """Raises ValueError if any row has a bad layer, blank content, profile or owner, or importance outside 0..10."""
    bad = adds.select(
        F.count_if(~F.coalesce(F.col("layer").isin(*LAYERS), F.lit(False))).alias(f"layer must be one of {LAYERS}"),
        F.count_if(is_blank("content")).alias("content must not be blank"),
        F.count_if(is_blank("profile_id") | is_blank("owner")).alias("profile_id and owner must not be blank"),
        F.count_if(~F.coalesce(F.col("importance").between(0, 10), F.lit(True))).alias("importance must be in 0..10"),
    ).first()
    for what, n in bad.asDict().items():
        if n:
            raise ValueError(f"{what}: {n} rows")


def fold_adds(adds: DataFrame) -> DataFrame:
    """State after ``adds`` (seq, profile_id, owner, layer, content, importance, ts, meta) in order of seq.

    Adding what is there changes last_accessed only; the id is that of the first add.
    """
    a = adds.select("seq", strip_u("profile_id").alias("profile_id"), strip_u("owner").alias("owner"), "layer", strip_u("content").alias("content"), F.coalesce("importance", F.lit(5.0)).alias("importance"), "ts", F.coalesce("meta", F.lit("{}")).alias("meta"))
    first = F.min(F.struct("seq", "importance", "ts", "meta"))
    return a.groupBy(*KEY).agg(first.alias("f"), F.max(F.struct("seq", "ts")).alias("l")).select(
        F.col("f.seq").alias("id"), *KEY, F.col("f.importance").alias("importance"), F.col("f.ts").alias("created_at"), F.col("l.ts").alias("last_accessed"), F.lit(1.0).alias("decay_score"), F.lit(False).alias("archived"), F.col("f.meta").alias("meta")
    )


def upsert(state: DataFrame, adds: DataFrame) -> DataFrame:
    """``state`` after ``adds``; old rows keep all but last_accessed."""
    new = fold_adds(adds).alias("n")
    old = state.alias("o")
    both = old.join(new, [F.col(f"o.{k}") == F.col(f"n.{k}") for k in KEY], "full")
    had = F.col("o.id").isNotNull()
    pick = lambda c: F.coalesce(F.col("n.last_accessed"), F.col("o.last_accessed")) if c == "last_accessed" else F.when(had, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}"))
    return both.select(*(pick(c).alias(c) for c in state.columns))


def missing(state: DataFrame, changes: DataFrame) -> DataFrame:
    """``changes`` (profile_id, owner, id) that name no row of ``state`` in their scope."""
    return changes.join(state.select(*SCOPE, "id"), [*SCOPE, "id"], "left_anti")


def edit(state: DataFrame, edits: DataFrame) -> DataFrame:
    """``state`` with the content of ``edits`` (seq, profile_id, owner, id, content), the last one per row; others have no effect."""
    last = edits.groupBy(*SCOPE, "id").agg(F.max(F.struct("seq", "content"))["content"].alias("__new"))
    out = state.join(last, [*SCOPE, "id"], "left")
    return out.withColumn("content", F.coalesce(strip_u("__new"), "content")).select(*state.columns)


def delete(state: DataFrame, deletes: DataFrame) -> DataFrame:
    return state.join(deletes.select(*SCOPE, "id").distinct(), [*SCOPE, "id"], "left_anti").select(*state.columns)


def decayed(now, stored="decay_score", last="last_accessed", layer="layer") -> Column:
    return col(stored) * F.pow(F.lit(0.5), days_between(F.lit(now) if isinstance(now, str) else now, last) / half_life(layer))


def apply_decay(state: DataFrame, now: str, from_created: bool = False) -> DataFrame:
    """Decay of all that is not archived; raw and episodic memories below the limit are archived.

    A stored 0 counts as 1. The stored score is multiplied without moving
    last_accessed, so a second call discounts the same days again;
    ``from_created`` instead takes the score from created_at alone.
    """
    stored = F.when(F.col("decay_score") == 0, 1.0).otherwise(F.col("decay_score"))
    value = decayed(now, F.lit(1.0), "created_at") if from_created else decayed(now, stored)
    live = ~F.col("archived")
    gone = live & F.col("layer").isin(*FADING) & (F.col("__d") < ARCHIVE_BELOW)
    new = {"archived": F.col("archived") | gone, "decay_score": F.when(live, F.col("__d")).otherwise(F.col("decay_score"))}
    return state.withColumn("__d", value).withColumns(new).select(*state.columns)


Relevance = Callable[[Column, Column], Column]


def scored(memories: DataFrame, query, now: str, layers: tuple[str, ...] = (), relevance: Relevance = bigram_jaccard) -> DataFrame:
    """Live rows with decayed score, relevance and score; those of no relevance are left out."""
    out = memories.filter(~F.col("archived"))
    if layers:
        out = out.filter(F.col("layer").isin(*layers))
    query = F.lit(query) if isinstance(query, str) else query
    out = out.withColumn("decay_score", decayed(now)).withColumn("relevance", relevance(query, F.col("content"))).filter("relevance > 0")
    return out.withColumn("score", F.greatest("decay_score", F.lit(0.01)) * F.col("relevance") * F.greatest("importance", F.lit(0.1)) / 10.0)


def scoped(state: DataFrame, profile_id: str, owner: str) -> DataFrame:
    return state.filter((F.col("profile_id") == profile_id) & (F.col("owner") == owner))


def recall(state: DataFrame, profile_id: str, owner: str, query: str, now: str, top_k: int = 5, layers: tuple[str, ...] = (), relevance: Relevance = bigram_jaccard) -> DataFrame:
    """The ``top_k`` best of one scope, equal scores by id."""
    if top_k < 0:
        raise ValueError("top_k must not be negative")
    return scored(scoped(state, profile_id, owner), query, now, layers, relevance).orderBy(F.desc("score"), "id").limit(top_k)


def touch(state: DataFrame, recalled: DataFrame, now: str) -> DataFrame:
    """``state`` with last_accessed set for the recalled rows; stored scores stay."""
    hit = recalled.select(*SCOPE, "id").distinct().withColumn("__hit", F.lit(now))
    return state.join(hit, [*SCOPE, "id"], "left").withColumn("last_accessed", F.coalesce("__hit", "last_accessed")).select(*state.columns)


def count(state: DataFrame, profile_id: str | None = None, owner: str | None = None) -> int:
    """Rows of a profile, an owner or both, archived ones included; at least one must be named."""
    if not profile_id and not owner:
        raise ValueError("count needs profile_id or owner")
    if profile_id:
        state = state.filter(F.col("profile_id") == profile_id)
    if owner:
        state = state.filter(F.col("owner") == owner)
    return state.count()


#: Rows of the log: ``new`` (a memory as first added, or as a full merge left it), ``text`` (its content from now on), ``seen`` (an access), ``gone``.
EVENT = "kind STRING, id BIGINT, profile_id STRING, owner STRING, seq BIGINT, layer STRING, content STRING, importance DOUBLE, at STRING, meta STRING, score DOUBLE, archived BOOLEAN, upto BIGINT"
EVENT_COLUMNS = [c.split()[0] for c in EVENT.split(", ")]
STATE_COLUMNS = [c.split()[0] for c in MEMORY_STATE.split(", ")]


def _events(df: DataFrame, kind: str | Column, **values) -> DataFrame:
    """Rows of the log from rows that have the scope and id; what is not given is null."""
    types = dict(c.split() for c in EVENT.split(", "))
    given = {"kind": F.lit(kind), **{c: F.col(c) for c in (*SCOPE, "id")}, **values}
    return df.select(*(given.get(c, F.lit(None)).cast(types[c]).alias(c) for c in EVENT_COLUMNS))


def fold_log(log: DataFrame, epochs: list[tuple[int, int | None]]) -> DataFrame:
    """The memories that ``log`` leaves: the state's columns, ``seen`` and ``born`` (numbers of the last access and the add) and ``faded`` (that of the decay that archived it).

    ``epochs`` are the decays, (number, microseconds): each multiplies the score of what is there and
    not archived by the days since the access before it, as ``apply_decay`` does at once. All is a
    minimum, a maximum or a short list per id (the accesses that no merge has folded yet).
    """
    kind = F.col("kind")
    access = F.when(kind == "seen", F.struct("seq", "us", "at"))
    g = log.withColumn("us", F.unix_micros(parse_ts("at"))).groupBy(*SCOPE, "id").agg(
        F.max(F.when(kind == "new", F.struct("seq", "layer", "importance", F.col("at").alias("created_at"), "meta", "score", "archived", "upto"))).alias("n"),
        F.max(F.when(kind.isin("new", "text"), F.struct("seq", kind == "text", "content")))["content"].alias("content"),
        F.bool_or(kind == "gone").alias("gone"),
        F.array_sort(F.collect_list(access)).alias("acc"),
    )
    g = g.filter(F.col("n").isNotNull() & ~F.col("gone"))
    start = F.struct(F.coalesce("n.score", F.lit(1.0)).alias("d"), F.coalesce("n.archived", F.lit(False)).alias("a"), F.lit(None).cast("long").alias("e"))
    if epochs:
        all_of = F.array(*(F.struct(F.lit(n).cast("long").alias("n"), F.lit(us).cast("long").alias("us")) for n, us in epochs))
        later = F.filter(all_of, lambda e: e["n"] > F.greatest(F.col("n.seq"), F.coalesce("n.upto", F.lit(-1))))

        def fade(s: Column, e: Column) -> Column:
            last = F.filter("acc", lambda x: x["seq"] < e["n"])
            days = F.coalesce(F.greatest((e["us"] - F.get(last, F.size(last) - 1)["us"]) / F.lit(86_400_000_000.0), F.lit(0.0)), F.lit(0.0))
            d = F.when(s["d"] == 0, 1.0).otherwise(s["d"]) * F.pow(F.lit(0.5), days / half_life("n.layer"))
            a = F.col("n.layer").isin(*FADING) & (d < ARCHIVE_BELOW)
            return F.when(s["a"], s).otherwise(F.struct(d.alias("d"), a.alias("a"), F.when(a, e["n"]).alias("e")))

        start = F.aggregate(later, start, fade)
    last = F.get("acc", F.size("acc") - 1)
    return g.withColumn("s", start).select(
        "id", *SCOPE, "n.layer", "content", "n.importance", "n.created_at", F.coalesce(last["at"], F.col("n.created_at")).alias("last_accessed"), F.col("s.d").alias("decay_score"), F.col("s.a").alias("archived"), "n.meta",
        F.coalesce(last["seq"], F.col("n.seq")).alias("seen"), F.col("n.seq").alias("born"), F.col("s.e").alias("faded"),
    )


class Conflict(RuntimeError):
    """Another writer has changed the same part of a store since it was read."""


class MemoryStore:
    """A table of memories as a log of events under a folder, in parts by a hash of the scope.

    - ``events/c=C/part=P``: a segment, the rows of one change; never rewritten. A change writes its own
      rows and nothing else: an add those that are new and an access of those that were there, an
      edit, a deletion or a recall a row a memory.
    - ``manifest/N.json``: the segments that count after N changes, and the decays, which are a number
      and a time each; ``apply_decay`` writes no row. States are folded when read (``fold_log``).

    A manifest is written aside and then put in its place, which fails if its number is taken; so a reader finds
    whole manifests at any time. The loser of a race reads again: accesses and decays are put after the
    other's change as they are, other changes are made anew if it touched the same parts. A recall's
    accesses never fail its answer.

    Segments of like size are merged when there are ``FAN`` of them, so a row is rewritten as often as
    the logarithm of the store. A merge of some keeps, of each memory, one row a kind (of its
    accesses the last before each decay); a merge of all leaves the state itself and settles the decays.
    What a merge replaces is deleted by the next one, so running readers keep their files.
    """

    FAN = 8  # segments of a size before they are merged
    UNIT = 1 << 20  # bytes of the smallest size
    MANY = 64  # decays before all is merged
    TRIES = 50

    def __init__(self, spark: SparkSession, path: str, parts: int = 64):
        self.spark, self.path = spark, path.rstrip("/")
        self.parts = self._manifest()["of"] or parts

    # files

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _names(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def _numbers(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self._names(f"{self.path}/manifest") if n.endswith(".json") and n[0] not in "._")

    def _manifest(self) -> dict:
        found = self._numbers()
        if not found:
            return {"n": -1, "of": 0, "last_id": 0, "segments": [], "epochs": [], "changed": {}, "stale": []}
        fs, p = self._fs(f"{self.path}/manifest/{found[-1]}.json")
        stream = fs.open(p)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _put(self, manifest: dict) -> bool:
        """Whether ``manifest`` is now the one of its number: whole, and nobody else's."""
        jvm = self.spark.sparkContext._jvm
        fs, aside = self._fs(f"{self.path}/manifest/_{uuid.uuid4().hex}")
        _, p = self._fs(f"{self.path}/manifest/{manifest['n']}.json")
        stream = fs.create(aside, False)
        stream.write(json.dumps(manifest).encode())
        stream.close()
        try:
            if fs.getScheme() == "file":  # a local rename would overwrite; a second link of one name cannot be made
                link, no_options = (jvm.java.nio.file.Path.of(x.toUri().getPath(), self.spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0)) for x in (p, aside))
                jvm.java.nio.file.Files.createLink(link, no_options)
            else:
                context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
                none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
                context.rename(aside, p, none)
            return True
        except Py4JJavaError:
            if fs.exists(p):
                return False
            raise
        finally:
            fs.delete(aside, False)

    def _drop(self, c: str) -> None:
        fs, p = self._fs(f"{self.path}/events/c={c}")
        fs.delete(p, True)

    # reading

    def _part(self, profile_id, owner) -> Column:
        return F.pmod(F.xxhash64(profile_id, owner), F.lit(self.parts)).cast("int")

    def _parts_of(self, changes: DataFrame) -> list[int]:
        scopes = changes.select(self._part(strip_u("profile_id"), strip_u("owner")).alias("p")).distinct()
        return [r["p"] for r in scopes.collect()]  # as many numbers as there are parts at most

    def _log(self, manifest: dict, parts: list[int] | None = None, only: list[dict] | None = None) -> DataFrame:
        """The rows of the segments, each with the number of its change."""
        segments = [s for s in (manifest["segments"] if only is None else only) if parts is None or set(parts) & set(s["parts"])]
        if not segments:
            return self.spark.createDataFrame([], f"{EVENT}, part INT")
        folders = [f"{self.path}/events/c={s['c']}" for s in segments]
        if parts is not None and len(parts) <= 4:
            folders = [f"{self.path}/events/c={s['c']}/part={p}" for s in segments for p in parts if p in s["parts"]]
        df = self.spark.read.schema(f"{EVENT}, c STRING, part INT").option("basePath", f"{self.path}/events").parquet(*folders)
        if parts is not None:
            df = df.filter(F.col("part").isin(*parts))
        number = F.create_map(*(F.lit(x) for s in segments for x in (s["c"], s["n"])))
        return df.withColumn("seq", F.coalesce("seq", F.element_at(number, F.col("c")).cast("long"))).drop("c")

    def _read(self, manifest: dict, parts: list[int] | None = None) -> DataFrame:
        return fold_log(self._log(manifest, parts), [(n, us) for n, us in manifest["epochs"]])

    def state(self, profile_id: str | None = None, owner: str | None = None) -> DataFrame:
        manifest = self._manifest()
        if profile_id is None or owner is None:
            return self._read(manifest).select(*STATE_COLUMNS)
        return scoped(self._read(manifest, [self._one(profile_id, owner)]), profile_id, owner).select(*STATE_COLUMNS)

    def _one(self, profile_id: str, owner: str) -> int:
        return self.spark.range(1).select(self._part(F.lit(profile_id), F.lit(owner))).first()[0]

    # writing

    def _write(self, rows: DataFrame) -> dict | None:
        """A segment of ``rows``, which no manifest names yet; None of no rows."""
        c = uuid.uuid4().hex
        out = rows.withColumn("part", self._part(F.col("profile_id"), F.col("owner")))
        out.hint("rebalance", F.col("part")).write.partitionBy("part").parquet(f"{self.path}/events/c={c}")  # a hot part is several tasks' work
        parts = sorted(int(n.removeprefix("part=")) for n in self._names(f"{self.path}/events/c={c}") if n.startswith("part="))
        if not parts:
            self._drop(c)
            return None
        fs, p = self._fs(f"{self.path}/events/c={c}")
        size, tier = fs.getContentSummary(p).getLength(), 0
        while size >= self.UNIT * self.FAN ** (tier + 1):
            tier += 1
        return {"c": c, "tier": tier, "parts": parts}

    def _commit(self, change: Callable[[dict], None], seen: dict | None = None, parts: list = ()) -> dict:
        """The next manifest, ``change`` of the last one; Conflict if ``parts`` were changed since ``seen``."""
        for _ in range(self.TRIES):
            last = self._manifest()
            if seen is not None and any(last["changed"].get(str(p), -1) > seen["n"] for p in parts):
                raise Conflict(f"{self.path}: another writer has changed the same part meanwhile")
            new = json.loads(json.dumps(last)) | {"n": last["n"] + 1, "of": last["of"] or self.parts}
            change(new)
            if self._put(new):
                return new
        raise RuntimeError(f"{self.path}: no turn in {self.TRIES} tries")

    def _append(self, rows: DataFrame, seen: dict, parts: list, ids: int = 0) -> None:
        """Commits ``rows`` as a change of ``parts`` as they were in ``seen``."""
        segment = self._write(rows)
        if segment is None:
            return

        def change(m: dict) -> None:
            m["segments"].append(segment | {"n": m["n"]})
            m["changed"] |= {str(p): m["n"] for p in segment["parts"]}
            if ids:
                m["last_id"] += ids
                m["changed"]["ids"] = m["n"]

        try:
            self._commit(change, seen, parts)
        except Exception:
            self._drop(segment["c"])
            raise

    def _again(self, attempt: Callable[[], None]) -> None:
        for left in reversed(range(self.TRIES)):
            try:
                attempt()
                break
            except Conflict:
                if not left:
                    raise
        self.merge()

    def add(self, adds: DataFrame) -> None:
        check_adds(adds)
        parts, new = self._parts_of(adds), fold_adds(adds)
        ids = adds.agg(F.max("seq")).first()[0] or 0

        def attempt() -> None:
            m = self._manifest()
            both = new.join(self._read(m, parts).select(*KEY, F.col("id").alias("__id")), list(KEY), "left")
            both = both.withColumn("id", F.coalesce("__id", F.col("id") + m["last_id"]))  # ids follow the last one used, in order of seq
            # one or two rows a memory out of one join
            both = both.withColumn("kind", F.explode(F.when(F.col("__id").isNull(), F.array(F.lit("new"), F.lit("seen"))).otherwise(F.array(F.lit("seen")))))
            new_only = {"layer": F.col("layer"), "content": F.col("content"), "importance": F.col("importance"), "meta": F.col("meta"), "score": F.lit(1.0), "archived": F.lit(False)}
            is_new = F.col("kind") == "new"
            rows = _events(both, F.col("kind"), at=F.when(is_new, F.col("created_at")).otherwise(F.col("last_accessed")), **{c: F.when(is_new, v) for c, v in new_only.items()})
            self._append(rows, m, [*parts, "ids"], ids)  # also made anew if other adds took the ids

        self._again(attempt)

    @contextmanager
    def _fixed(self, df: DataFrame) -> Iterator[DataFrame]:
        """``df`` written once, since it is used several times and may be the outcome of a fold of the whole store."""
        path = f"{self.path}/work/{uuid.uuid4().hex}"
        df.write.parquet(path)
        try:
            yield self.spark.read.schema(df.schema).parquet(path)
        finally:
            fs, p = self._fs(path)
            fs.delete(p, True)

    def edit(self, edits: DataFrame) -> None:
        with self._fixed(edits.select("seq", *SCOPE, "id", F.col("content").cast("string"))) as edits:
            parts = self._parts_of(edits)

            def attempt() -> None:
                m = self._manifest()
                with self._fixed(self._read(m, parts).select("id", *KEY)) as state:
                    self._in_scope(state, edits)
                    if not edit(state, edits).groupBy(*KEY).count().filter("count > 1").isEmpty():
                        raise ValueError("an edit would repeat a memory of its scope and layer")
                last = edits.groupBy(*SCOPE, "id").agg(strip_u(F.max(F.struct("seq", "content"))["content"]).alias("content"))
                self._append(_events(last.filter("content IS NOT NULL"), "text", content=F.col("content")), m, parts)

            self._again(attempt)

    def delete(self, deletes: DataFrame) -> None:
        with self._fixed(deletes.select(*SCOPE, "id").distinct()) as deletes:
            parts = self._parts_of(deletes)

            def attempt() -> None:
                m = self._manifest()
                self._in_scope(self._read(m, parts), deletes)
                self._append(_events(deletes, "gone"), m, parts)

            self._again(attempt)

    @staticmethod
    def _in_scope(state: DataFrame, changes: DataFrame) -> None:
        if lost := missing(state, changes).limit(1).collect():
            raise LookupError(f"memory {lost[0]['id']} is not in its scope")

    def apply_decay(self, now: str, count: bool = True) -> int | None:
        """Decays the whole store, which writes its time only; how many this archives is counted in one pass, if asked."""
        us = self.spark.range(1).select(F.unix_micros(parse_ts(F.lit(now)))).first()[0]
        m = self._commit(lambda m: m["epochs"].append([m["n"], us]))
        lost = self._read(m).filter(F.col("faded") == m["n"]).count() if count else None
        self.merge()
        return lost

    def recall(self, profile_id: str, owner: str, query: str, now: str, top_k: int = 5, layers: tuple[str, ...] = (), relevance: Relevance = bigram_jaccard) -> list:
        """The best rows of a scope (at most ``top_k``); marks them as accessed, which writes these rows' marks only.

        Should the marks not be kept, the answer is given nevertheless, with a warning.
        """
        state = self._read(self._manifest(), [self._one(profile_id, owner)]).select(*STATE_COLUMNS)
        got = recall(state, profile_id, owner, query, now, top_k, layers, relevance).collect()
        if got:
            try:
                marks = self.spark.createDataFrame([(r["profile_id"], r["owner"], r["id"]) for r in got], "profile_id string, owner string, id long")
                segment = self._write(_events(marks, "seen", at=F.lit(now)))
                self._commit(lambda m: m["segments"].append(segment | {"n": m["n"]}))
                if len(self._manifest()["segments"]) > 4 * self.FAN:
                    self.merge()
            except Exception as e:
                warnings.warn(f"{self.path}: the recall's marks are lost: {e}", stacklevel=2)
        return got

    def count(self, profile_id: str | None = None, owner: str | None = None) -> int:
        return count(self.state(), profile_id, owner)

    # merging

    def merge(self, whole: bool = False) -> None:
        """Merges segments of like size where there are many, or all of them; leaves it to another writer who is at it."""
        while True:
            m = self._manifest()
            tiers: dict[int, list[dict]] = {}
            for s in m["segments"]:
                tiers.setdefault(s["tier"], []).append(s)
            full = next((tiers[t] for t in sorted(tiers) if len(tiers[t]) >= self.FAN), None)
            if whole or len(m["epochs"]) > self.MANY:
                full = m["segments"]
            if not full:
                return
            settled = len(full) == len(m["segments"])
            segment = self._write(self._settled(m) if settled else self._merged(m, full))
            gone = {s["c"] for s in full}

            def change(new: dict, m=m, gone=gone, segment=segment, settled=settled) -> None:
                if not gone <= {s["c"] for s in new["segments"]}:
                    raise Conflict(f"{self.path}: another writer has merged the same segments")
                new["segments"] = [s for s in new["segments"] if s["c"] not in gone] + ([segment | {"n": m["n"]}] if segment else [])
                if settled:
                    new["epochs"] = [e for e in new["epochs"] if e[0] > m["n"]]
                new["stale"] = sorted(gone)

            stale = m["stale"]
            try:
                self._commit(change)
            except Conflict:
                if segment:
                    self._drop(segment["c"])
                return
            for c in stale:
                self._drop(c)
            for n in self._numbers()[: -self.MANY]:
                fs, p = self._fs(f"{self.path}/manifest/{n}.json")
                fs.delete(p, False)
            if whole or settled:
                return

    def _merged(self, m: dict, segments: list[dict]) -> DataFrame:
        """The rows of some segments, one a memory and kind; of accesses the last of each span between decays."""
        span = F.size(F.filter(F.array(*(F.lit(n).cast("long") for n, _ in m["epochs"])).cast("array<bigint>"), lambda n: n < F.col("seq")))
        log = self._log(m, only=segments).withColumn("span", F.when(F.col("kind") == "seen", span).otherwise(0))
        rest = [c for c in EVENT_COLUMNS if c not in ("kind", "id", *SCOPE, "seq")]
        last = log.groupBy("kind", *SCOPE, "id", "span").agg(F.max(F.struct("seq", *rest)).alias("w"))
        return last.select(*(F.col(f"w.{c}").alias(c) if c in ("seq", *rest) else F.col(c) for c in EVENT_COLUMNS))

    def _settled(self, m: dict) -> DataFrame:
        """The state as rows of the log, its decays done."""
        s = self._read(m)
        kept = _events(s, "new", seq=F.col("born"), layer=F.col("layer"), content=F.col("content"), importance=F.col("importance"), at=F.col("created_at"), meta=F.col("meta"), score=F.col("decay_score"), archived=F.col("archived"), upto=F.lit(m["n"]))
        return kept.unionByName(_events(s, "seen", seq=F.col("seen"), at=F.col("last_accessed")))
