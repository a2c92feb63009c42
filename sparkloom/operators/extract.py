"""The extraction stage: one client call per block, resumable through a ledger.

Calls cost money, so their results are kept before anything is derived from them, by
the task that made the call and as soon as it has the reply (``journal``), not when its
job commits. Another attempt of a task takes what earlier ones have kept instead of
calling again, and a resumed run calls only for blocks whose latest row is not done,
whether the run before it ended or died.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.batches import parts
from ..functions.text import drop_blank, extract_json, strip_u
from ..types import LEDGER, LIST_FIELDS
from . import journal
from .journal import SECONDS, Appender

ERROR_CHARS = 200
LEDGER_COLUMNS = [c.split()[0] for c in LEDGER.split(", ")]


class ProviderError(RuntimeError):
    """A call that gave no usable response."""


@dataclass(frozen=True)
class ChatResult:
    text: str
    prompt_tokens: int = 0
    completion_tokens: int = 0


@dataclass(frozen=True)
class ClientConfig:
    base_url: str
    api_key: str
    model: str
    timeout: float = 120.0
    retries: int = 3
    backoff: float = 1.0

    def __post_init__(self):
        if not (self.base_url and self.api_key and self.model):
            raise ValueError("base_url, api_key and model are needed")


class HttpClient:
    """A chat-completions endpoint. Too many requests wait longest, server and network faults double the wait, other faults end at once."""

    def __init__(self, config: ClientConfig, opener: Callable = urllib.request.urlopen, sleep: Callable[[float], None] = time.sleep):
        self.config, self.opener, self.sleep = config, opener, sleep

    def chat(self, block_id: int, system: str, user: str) -> ChatResult:
        c, wait, why = self.config, self.config.backoff, ""
        body = {"model": c.model, "messages": [{"role": "system", "content": system}, {"role": "user", "content": user}], "response_format": {"type": "json_object"}}
        request = urllib.request.Request(c.base_url.rstrip("/") + "/chat/completions", json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {c.api_key}"})
        for _ in range(c.retries):
            try:
                with self.opener(request, timeout=c.timeout) as reply:
                    data = json.loads(reply.read())
                usage = data.get("usage") or {}
                if not data.get("choices"):
                    raise ProviderError("the response has no choices")
                return ChatResult(data["choices"][0]["message"]["content"] or "", int(usage.get("prompt_tokens") or 0), int(usage.get("completion_tokens") or 0))
            except urllib.error.HTTPError as e:
                why = f"HTTP {e.code}"
                if e.code != 429 and e.code < 500:
                    raise ProviderError(why) from e
                self.sleep(wait * 4 if e.code == 429 else wait)
                wait = wait + 4 if e.code == 429 else wait * 2
            except ProviderError:
                raise
            except (OSError, ValueError, KeyError, TypeError) as e:  # network faults, timeouts, bodies that do not parse
                why = f"{type(e).__name__}: {e}"
                self.sleep(wait)
                wait *= 2
        raise ProviderError(f"no response in {c.retries} tries: {why}")


@dataclass
class KeyedFake:
    """Canned replies by block id, in turn; for tests. An exhausted list is a failed call."""

    replies: dict[int, list[str]]
    used: dict[int, int] = field(default_factory=dict)

    def chat(self, block_id: int, system: str, user: str) -> ChatResult:
        n = self.used.get(block_id, 0)
        self.used[block_id] = n + 1
        if n >= len(self.replies.get(block_id, [])):
            raise ProviderError("no reply left")
        return ChatResult(self.replies[block_id][n], 10, 20)


def object_in(text: str) -> dict:
    """The JSON object between the first and the last brace; ValueError without one."""
    start, end = text.find("{"), text.rfind("}")
    if start < 0 or end <= start:
        raise ValueError(f"no JSON object in the reply: {text[:120]!r}")
    found = json.loads(text[start : end + 1])
    if not isinstance(found, dict):
        raise ValueError("the reply is no JSON object")
    return found


#: Folders of a run's journal; a task lists only those of its own blocks.
BUCKETS = 64


def bucket_of(block_id="block_id") -> Column:
    return F.pmod(F.xxhash64(F.col(block_id).cast("long")), F.lit(BUCKETS)).cast("int")


def call_blocks(blocks: DataFrame, factory: Callable[[], object], system: str, run_id: str, seq: int, path: str, max_attempts: int = 2, every: int | None = None, seconds: float = SECONDS) -> DataFrame:
    """(called, kept): calls for ``blocks`` (block_id, rendered, before), each until a reply holds an object, at most ``max_attempts`` times.

    The ledger rows go to the journal at ``path``, a folder for each bucket of blocks; ``called`` counts the
    blocks of this attempt, ``kept`` those that an earlier attempt of the run has kept already.
    """

    def call(client, block_id: int, user: str, before: int) -> dict:
        status, error, reply, calls, asked, told = "failed", "", None, 0, 0, 0
        for _ in range(max_attempts):
            calls += 1
            try:
                got = client.chat(block_id, system, user)
                asked, told = asked + got.prompt_tokens, told + got.completion_tokens
                object_in(got.text)
                status, error, reply = "done", "", got.text
                break
            except Exception as e:  # any fault of a client is a failed attempt
                error = str(e)[:ERROR_CHARS]
        return dict(zip(LEDGER_COLUMNS, (run_id, seq, block_id, status, before + (status == "failed"), error, calls, asked, told, reply), strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client, at, kept, log = None, None, set(), None
        called = had = 0
        try:
            for part in (part for whole in batches for part in parts(whole, "rendered")):
                for bucket, block_id, user, before in zip(*(part.column(c).to_pylist() for c in ("bucket", "block_id", "rendered", "before")), strict=True):
                    if bucket != at:
                        if log is not None:
                            log.flush()
                        at, folder = bucket, f"{path}/bucket={bucket}"
                        kept, log = {r["block_id"] for r in journal.read(folder)}, Appender(folder, every, seconds)
                    if block_id in kept:
                        had += 1
                        continue
                    client = client or factory()
                    log.append(call(client, int(block_id), user, int(before)))
                    log.settle()
                    called += 1
        finally:
            if log is not None:
                log.flush()
        yield pa.RecordBatch.from_pydict({"called": [called], "kept": [had]})

    todo = blocks.select(bucket_of().alias("bucket"), "block_id", "rendered", "before")
    return todo.repartition("bucket").sortWithinPartitions("bucket", "block_id").mapInArrow(run, "called long, kept long")


class Ledger:
    """The ledger of one profile or book, a folder.

    ``journal/seq=N`` has what the tasks of run N have kept, ``runs/seq=N`` the same folded into
    Parquet once the run has ended; that one counts where it is complete. A run that
    died leaves its journal, which is read like any other.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _runs(self, kind: str) -> set[int]:
        fs, p = self._fs(f"{self.path}/{kind}")
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return {int(n.removeprefix("seq=")) for n in names if n.startswith("seq=")}

    def _folded(self) -> set[int]:
        done = set()
        for n in self._runs("runs"):
            fs, p = self._fs(f"{self.path}/runs/seq={n}/_SUCCESS")
            if fs.exists(p):
                done.add(n)
        return done

    def rows(self) -> DataFrame:
        """One row per block and run."""
        folded = self._folded()
        open_ = self._runs("journal") - folded
        out = self.spark.createDataFrame([], LEDGER)
        if folded:
            out = out.unionByName(self.spark.read.schema(LEDGER).option("basePath", f"{self.path}/runs").parquet(*(f"{self.path}/runs/seq={n}" for n in sorted(folded))).select(*LEDGER_COLUMNS))
        if open_:
            told = self.spark.read.schema(f"{LEDGER}, bucket INT").json([f"{self.path}/journal/seq={n}/bucket=*/*.json" for n in sorted(open_)])
            out = out.unionByName(fold(told.select(*LEDGER_COLUMNS)))
        return out

    def latest(self) -> DataFrame:
        """One row per block: that of its last run."""
        return latest(self.rows())

    def run(self, blocks: DataFrame, factory, system: str, run_id: str, max_attempts: int = 2, only: DataFrame | None = None, every: int | None = None, seconds: float = SECONDS) -> None:
        """Calls for all ``blocks`` (block_id, rendered) that are not done, or those of them in ``only``."""
        seq = max(self._runs("journal") | self._runs("runs"), default=-1) + 1
        # of earlier runs two numbers a block, without the replies
        state = self.rows().groupBy("block_id").agg(F.max_by(F.col("status") == "done", "seq").alias("done"), F.max_by("attempts", "seq").alias("before"))
        todo = blocks.select("block_id", "rendered").join(state, "block_id", "left").filter("done IS NOT TRUE")
        if only is not None:
            todo = todo.join(only.select("block_id").distinct(), "block_id", "left_semi")
        todo = todo.select("block_id", "rendered", F.coalesce("before", F.lit(0)).alias("before"))
        call_blocks(todo, factory, system, run_id, seq, f"{self.path}/journal/seq={seq}", max_attempts, every, seconds).agg(F.sum("called")).collect()
        self.fold_run(seq)

    def fold_run(self, seq: int) -> None:
        """Writes a run's journal as Parquet and then deletes it; done again after a crash it does no harm."""
        if seq in self._runs("journal") and seq not in self._folded():
            told = self.spark.read.schema(f"{LEDGER}, bucket INT").json(f"{self.path}/journal/seq={seq}/bucket=*/*.json")
            fold(told.select(*LEDGER_COLUMNS)).drop("seq").write.mode("overwrite").parquet(f"{self.path}/runs/seq={seq}")
        if seq in self._folded():
            fs, p = self._fs(f"{self.path}/journal/seq={seq}")
            fs.delete(p, True)

    def stats(self) -> DataFrame:
        return run_stats(self.rows())


def fold(told: DataFrame) -> DataFrame:
    """One row per block and run of what tasks have kept.

    Two attempts of one task may both have called for a block: a done row goes before a failed one,
    and calls and tokens of both were paid for.
    """
    rest = [c for c in LEDGER_COLUMNS if c not in ("seq", "block_id", "calls", "prompt_tokens", "completion_tokens")]
    won = told.groupBy("seq", "block_id").agg(F.min(F.struct((F.col("status") != "done").alias("open"), *rest)).alias("w"), *(F.sum(c).cast(told.schema[c].dataType).alias(c) for c in ("calls", "prompt_tokens", "completion_tokens")))
    return won.select(*(F.col(f"w.{c}").alias(c) if c in rest else F.col(c) for c in LEDGER_COLUMNS))


def latest(rows: DataFrame) -> DataFrame:
    rest = [c for c in rows.columns if c not in ("block_id", "seq")]
    won = rows.groupBy("block_id").agg(F.max(F.struct("seq", *rest)).alias("w"))
    return won.select(*(F.col("block_id") if c == "block_id" else F.col(f"w.{c}").alias(c) for c in rows.columns))


def run_stats(rows: DataFrame) -> DataFrame:
    """One row: blocks_done, blocks_failed, failed_blocks in order, calls and tokens of all runs."""
    used = rows.agg(F.coalesce(F.sum("calls"), F.lit(0)).alias("calls"), F.coalesce(F.sum("prompt_tokens"), F.lit(0)).alias("prompt_tokens"), F.coalesce(F.sum("completion_tokens"), F.lit(0)).alias("completion_tokens"))
    ended = latest(rows.select("block_id", "seq", "status")).agg(F.count_if(F.col("status") == "done").alias("blocks_done"), F.count_if(F.col("status") == "failed").alias("blocks_failed"), F.array_sort(F.collect_list(F.when(F.col("status") == "failed", F.col("block_id")))).alias("failed_blocks"))
    return ended.join(F.broadcast(used), F.lit(True))  # one row each


def _items(v, path: str):
    """A list member as strings; a lone string counts as a list of one."""
    one = F.try_variant_get(v, path, "string")
    is_text = F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING"
    return drop_blank(F.when(is_text, F.array(one)).otherwise(F.try_variant_get(v, path, "array<string>")))


def _objects(v, path: str):
    return F.filter(F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>")), lambda x: F.schema_of_variant(x).startswith("OBJECT"))


def _get(v, path: str):
    return strip_u(F.coalesce(F.try_variant_get(v, path, "string"), F.lit("")))


def _lore(x):
    content, title = _get(x, "$.content"), _get(x, "$.title")
    return F.struct(F.when(title != "", title).otherwise(F.substring(content, 1, 20)).alias("title"), content.alias("content"), _get(x, "$.keys").alias("keys"))


def fragments(ledger: DataFrame) -> DataFrame:
    """One row per done block: list fields, scene_tone, lore_candidates, evidence (not yet verified)."""
    f = ledger.filter("status = 'done'").withColumn("v", extract_json("reply"))
    v = F.col("v")
    tones = F.map_entries(F.coalesce(F.try_variant_get(v, "$.scene_tone", "map<string,string>"), F.create_map().cast("map<string,string>")))
    return f.select(
        "block_id", *(_items(v, f"$.{c}").alias(c) for c in LIST_FIELDS),
        F.filter(F.transform(tones, lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v"))), lambda e: strip_u(F.coalesce(e["v"], F.lit(""))) != "").alias("scene_tone"),
        F.filter(F.transform(_objects(v, "$.lore_candidates"), _lore), lambda x: x["content"] != "").alias("lore_candidates"),
        F.transform(_objects(v, "$.evidence"), lambda x: F.struct(_get(x, "$.quote").alias("quote"), F.try_variant_get(x, "$.message_index", "string").alias("message_index"), _get(x, "$.speaker").alias("speaker"))).alias("evidence"),
    )


def characters(ledger: DataFrame) -> DataFrame:
    """(block_id, pos, name, identity, speaking_style, traits, relationships) of done blocks of a novel."""
    f = ledger.filter("status = 'done'").withColumn("v", extract_json("reply"))
    rows = f.select("block_id", F.posexplode(_objects(F.col("v"), "$.characters")).alias("pos", "c"))
    c = F.col("c")
    return rows.select("block_id", "pos", *(_get(c, f"$.{n}").alias(n) for n in ("name", "identity", "speaking_style")), F.transform(_items(c, "$.traits"), strip_u).alias("traits"), _get(c, "$.relationships").alias("relationships")).filter("name <> ''")
