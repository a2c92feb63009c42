"""Results of calls outlive the task, the job and the session that made them."""

import json
import os
import sys
from functools import partial
from pathlib import Path

import pandas as pd
import pyspark.cloudpickle
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import extract, journal
from sparkloom.operators.extract import Ledger

BLOCKS = "block_id long, rendered string"


class Counting:
    """Leaves a file for each call; dies with its whole worker once there are ``limit`` of them; fails for some blocks."""

    def __init__(self, folder, limit=None, bad=()):
        self.folder, self.limit, self.bad = Path(folder), limit, bad

    def chat(self, block_id, system, user):
        if self.limit is not None and len(list(self.folder.iterdir())) >= self.limit:
            os._exit(1)
        (self.folder / f"{block_id}-{os.urandom(4).hex()}").touch()
        return extract.ChatResult("nothing" if block_id in self.bad else json.dumps({"traits": [user]}), 2, 3)


pyspark.cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import the tests


def clients(folder, limit=None, bad=()):
    return partial(Counting, str(folder), limit, bad)


def calls(folder):
    return sorted(int(f.name.split("-")[0]) for f in Path(folder).iterdir())


def test_a_killed_run_keeps_what_it_paid_for(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    blocks = spark.createDataFrame([(i, f"text {i}") for i in range(24)], BLOCKS)
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    with pytest.raises(Exception, match="(?i)worker|exit|crash"):
        ledger.run(blocks, clients(tmp_path / "calls", 20), "s", "first", every=1)
    paid = calls(tmp_path / "calls")
    assert len(paid) >= 20
    kept = sorted(r.block_id for r in Ledger(spark, str(tmp_path / "ledger")).rows().collect())
    # at most the calls under way when the workers died are lost, one a worker
    assert set(kept) <= set(paid) and len(kept) >= len(paid) - 4
    Ledger(spark, str(tmp_path / "ledger")).run(blocks, clients(tmp_path / "calls"), "s", "second")
    assert len(calls(tmp_path / "calls")) == len(paid) + 24 - len(kept)
    s = ledger.stats().first()
    assert (s.blocks_done, s.blocks_failed, s.calls) == (24, 0, 24)
    assert {json.loads(r.reply)["traits"][0] for r in ledger.latest().collect()} == {f"text {i}" for i in range(24)}


def test_another_attempt_does_not_call_again(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    blocks = spark.createDataFrame([(i, f"text {i}", 0) for i in range(30)], BLOCKS + ", before int")
    go = lambda n: extract.call_blocks(blocks.filter(F.col("block_id") < n), clients(tmp_path / "calls", bad=(3,)), "s", "r", 0, str(tmp_path / "l/journal/seq=0")).agg(F.sum("called"), F.sum("kept")).first()
    assert tuple(go(10)) == (10, 0)
    assert tuple(go(30)) == (20, 10)
    assert len(calls(tmp_path / "calls")) == 31  # block 3 was tried twice
    ledger = Ledger(spark, str(tmp_path / "l"))
    before = sorted(map(tuple, ledger.rows().collect()), key=repr)
    assert len(before) == 30 and sum(r[3] == "failed" for r in before) == 1
    ledger.fold_run(0)
    ledger.fold_run(0)
    assert sorted(map(tuple, ledger.rows().collect()), key=repr) == before and not (tmp_path / "l/journal/seq=0").exists()
    ledger.run(blocks, clients(tmp_path / "calls"), "s", "r2")
    assert calls(tmp_path / "calls").count(3) == 3 and len(calls(tmp_path / "calls")) == 32


def test_fold_counts_all_calls_and_prefers_done(spark):
    row = lambda seq, block, status, calls, reply: ("r", seq, block, status, 0, "", calls, 10, 5, reply)
    told = spark.createDataFrame([row(0, 1, "failed", 2, None), row(0, 1, "done", 1, "{}"), row(0, 2, "failed", 2, None), row(1, 2, "done", 1, "{}")], extract.LEDGER)
    got = {(r.seq, r.block_id): (r.status, r.calls, r.prompt_tokens, r.reply) for r in extract.fold(told).collect()}
    assert got == {(0, 1): ("done", 3, 20, "{}"), (0, 2): ("failed", 2, 10, None), (1, 2): ("done", 1, 10, "{}")}


def test_half_folded_run_is_read_from_its_journal(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    ledger, blocks = Ledger(spark, str(tmp_path / "l")), spark.createDataFrame([(1, "a"), (2, "b")], BLOCKS)
    extract.call_blocks(blocks.withColumn("before", F.lit(0)), clients(tmp_path / "calls"), "s", "r", 0, str(tmp_path / "l/journal/seq=0")).collect()
    (tmp_path / "l/runs/seq=0").mkdir(parents=True)  # a fold that died: no mark of success
    assert ledger.rows().count() == 2
    ledger.run(blocks, clients(tmp_path / "calls"), "s", "r")
    assert len(calls(tmp_path / "calls")) == 2


def test_appender(tmp_path):
    now = [0.0]
    log = journal.Appender(str(tmp_path / "j"), every=3, seconds=5, clock=lambda: now[0])
    seen = lambda: [r["n"] for r in journal.read(str(tmp_path / "j"))]
    for n in range(3):
        assert seen() == []
        log.append({"n": n})
        log.settle()
    assert seen() == [0, 1, 2]
    log.append({"n": 3})
    log.settle()
    assert 3 not in seen()
    now[0] = 6.0
    log.settle()
    assert sorted(seen()) == [0, 1, 2, 3]
    with pytest.raises(KeyError), journal.Appender(str(tmp_path / "j")) as other:
        other.append({"n": 4})
        raise KeyError
    assert sorted(seen()) == [0, 1, 2, 3, 4]
    (tmp_path / "j" / "_half.json").write_text('{"n": 9')  # one that was never renamed
    assert sorted(seen()) == [0, 1, 2, 3, 4] and list(journal.read(str(tmp_path / "none"))) == []


def test_no_blocks(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "l"))
    ledger.run(spark.createDataFrame([], BLOCKS), partial(extract.KeyedFake, {}), "s", "r")
    assert ledger.rows().count() == 0 and ledger.stats().first().blocks_done == 0
    assert isinstance(ledger.latest().toPandas(), pd.DataFrame)


def test_quick_calls_make_few_files(tmp_path):
    now = [0.0]
    log = journal.Appender(str(tmp_path / "j"), clock=lambda: now[0])
    files = lambda: len(list((tmp_path / "j").glob("*.json"))) if (tmp_path / "j").exists() else 0
    for n in range(5_000):
        log.append({"n": n})
        log.settle()
    assert files() == 0  # nothing has waited a second
    now[0] = 1.0
    log.append({"n": 5_000})
    log.settle()
    assert files() == 1
    for n in range(5):  # large rows do not wait
        log.append({"n": "x" * journal.BYTES})
        log.settle()
    assert files() == 6
    assert sum(1 for _ in journal.read(str(tmp_path / "j"))) == 5_006
