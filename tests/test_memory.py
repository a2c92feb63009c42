import random
import threading
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import memory as m

ADDS = "seq long, profile_id string, owner string, layer string, content string, importance double, ts string, meta string"


def adds(spark, rows):
    return spark.createDataFrame([(i, *r, None) for i, r in enumerate(rows, 1)], ADDS)


def test_validation(spark, tmp_path):
    store = m.MemoryStore(spark, str(tmp_path / "v"))
    for bad in (("p", "o", "dream", "x", 5.0, "2026-01-01"), ("p", "o", "raw", "  ", 5.0, "2026-01-01"), (" ", "o", "raw", "x", 5.0, "2026-01-01"), ("p", "o", "raw", "x", 11.0, "2026-01-01")):
        with pytest.raises(ValueError):
            store.add(adds(spark, [bad]))
    assert store.state().count() == 0


def test_upsert_keeps_the_first(spark, tmp_path):
    store = m.MemoryStore(spark, str(tmp_path / "u"))
    store.add(adds(spark, [("p", "o", "raw", "a", 3.0, "2026-01-01"), ("p", "o", "raw", "b", 4.0, "2026-01-02"), ("p", "o", "raw", " a ", 9.0, "2026-01-03")]))
    store.add(adds(spark, [("p", "o", "raw", "b", 1.0, "2026-01-05"), ("p", "o", "core", "b", 1.0, "2026-01-05")]))
    got = sorted((r.id, r.layer, r.content, r.importance, r.created_at, r.last_accessed) for r in store.state().collect())
    assert got[:2] == [(1, "raw", "a", 3.0, "2026-01-01", "2026-01-03"), (2, "raw", "b", 4.0, "2026-01-02", "2026-01-05")]
    assert got[2][1:4] == ("core", "b", 1.0) and got[2][0] > 2


def test_scopes_do_not_mix(spark, tmp_path):
    store = m.MemoryStore(spark, str(tmp_path / "s"), parts=4)
    store.add(adds(spark, [(p, o, "core", f"secret of {p} {o}", 5.0, "2026-01-01") for p in ("p1", "p2") for o in ("a", "b")]))
    for p in ("p1", "p2"):
        for o in ("a", "b"):
            assert [r.content for r in store.recall(p, o, "secret", "2026-01-02", 10)] == [f"secret of {p} {o}"]
    assert store.count("p1") == 2 and store.count(owner="a") == 2 and store.count("p1", "a") == 1
    with pytest.raises(ValueError):
        store.count()


def test_three_factors_and_touch(spark, tmp_path):
    store = m.MemoryStore(spark, str(tmp_path / "f"))
    store.add(adds(spark, [("p", "o", "episodic", "likes green tea", 5.0, "2026-01-01"), ("p", "o", "episodic", "likes black tea", 5.0, "2026-02-01"), ("p", "o", "semantic", "likes tea leaves", 9.0, "2026-02-01"), ("p", "o", "raw", "zzz", 9.0, "2026-02-01")]))
    got = store.recall("p", "o", "likes tea", "2026-02-02", 2)
    assert [r.content for r in got] == ["likes tea leaves", "likes black tea"]
    seen = {r.content: r.last_accessed for r in store.state().collect()}
    assert seen["likes tea leaves"] == "2026-02-02" and seen["likes green tea"] == "2026-01-01"
    assert store.recall("p", "o", "qqq", "2026-02-02") == []
    assert [r.content for r in store.recall("p", "o", "likes tea", "2026-02-02", layers=("episodic",))] == ["likes black tea", "likes green tea"]
    by_length = lambda q, c: F.length(c) / 100.0
    assert store.recall("p", "o", "-", "2026-02-02", 1, relevance=by_length)[0].content == "likes tea leaves"
    with pytest.raises(ValueError):
        store.recall("p", "o", "x", "2026-02-02", -1)


def test_decay_archives_what_fades(spark, tmp_path):
    store = m.MemoryStore(spark, str(tmp_path / "d"))
    store.add(adds(spark, [("p", "o", layer, "x", 5.0, "2026-01-01") for layer in ("raw", "episodic", "semantic", "core")]))
    assert store.apply_decay("2026-06-30") == 2  # 180 days
    got = {r.layer: (round(r.decay_score, 6), r.archived) for r in store.state().collect()}
    assert got == {"raw": (round(0.5**6, 6), True), "episodic": (round(0.5 ** (180 / 14), 6), True), "semantic": (round(0.5 ** (180 / 3650), 6), False), "core": (round(0.5 ** (180 / 3650), 6), False)}
    before = got["core"][0]
    store.apply_decay("2026-06-30")  # the same days again
    assert abs({r.layer: r.decay_score for r in store.state().collect()}["core"] - before**2) < 1e-5
    store.add(adds(spark, [("p", "o", "raw", "x", 5.0, "2026-07-01")]))
    assert {r.layer: r.archived for r in store.state().collect()}["raw"]  # adding again does not revive
    assert store.count("p") == 4


def test_edit_and_delete_in_scope(spark, tmp_path):
    store = m.MemoryStore(spark, str(tmp_path / "e"))
    store.add(adds(spark, [("p", "o", "core", "old", 5.0, "2026-01-01"), ("p", "o", "core", "other", 5.0, "2026-01-01")]))
    change = lambda owner, i, text: spark.createDataFrame([(1, "p", owner, i, text)], "seq long, profile_id string, owner string, id long, content string")
    for act in (store.edit, store.delete):
        with pytest.raises(LookupError):
            act(change("x", 1, "new"))
    with pytest.raises(ValueError):
        store.edit(change("o", 1, "other"))
    store.edit(change("o", 1, " new "))
    assert {r.content for r in store.state().collect()} == {"new", "other"}
    store.delete(change("o", 1, ""))
    assert {r.content for r in store.state().collect()} == {"other"}


def segments(store):
    return {s["c"] for s in store._manifest()["segments"]}


def rows_of(spark, tmp_path, names):
    return sum(spark.read.parquet(str(f)).count() for n in names for f in (tmp_path / "m/events" / f"c={n}").rglob("*.parquet"))


def test_every_change_writes_its_own_rows(spark, tmp_path):
    store = m.MemoryStore(spark, str(tmp_path / "m"), parts=4)
    store.add(spark.createDataFrame([(i, f"p{i % 5}", "o", "raw", f"note {i}", 5.0, "2026-01-01", None) for i in range(40)], ADDS))
    first = segments(store)
    got = store.recall("p1", "o", "note", "2026-01-02", 3)
    again = store.recall("p1", "o", "note", "2026-01-05", 1)
    assert len(got) == 3 and rows_of(spark, tmp_path, segments(store) - first) == 4
    marked = {r.id: r.last_accessed for r in store.state().collect()}
    want = {r["id"]: "2026-01-02" for r in got} | {r["id"]: "2026-01-05" for r in again}
    assert {i: t for i, t in marked.items() if t != "2026-01-01"} == want
    then = segments(store)
    assert then > first
    store.add(spark.createDataFrame([(1, "p1", "o", "raw", "one more", 5.0, "2026-01-06", None), (2, "p1", "o", "raw", "note 1", 5.0, "2026-01-07", None)], ADDS))
    assert segments(store) > then and rows_of(spark, tmp_path, segments(store) - then) == 3  # a new one with its access, and an access
    then = segments(store)
    change = spark.createDataFrame([(1, "p1", "o", 6, "changed")], "seq long, profile_id string, owner string, id long, content string")
    store.edit(change)
    store.delete(change)
    assert rows_of(spark, tmp_path, segments(store) - then) == 2
    then = segments(store)
    assert store.apply_decay("2026-01-08") == 0 and segments(store) == then  # a time in the manifest
    assert store.count("p1") == 8 and store.state().agg({"id": "max"}).first()[0] == 40
    store.merge(whole=True)
    assert len(segments(store)) == 1 and store._manifest()["epochs"] == [] and store.count("p1") == 8


def test_parts_are_those_of_the_store(spark, tmp_path):
    m.MemoryStore(spark, str(tmp_path / "m"), parts=3).add(adds(spark, [(f"p{i}", "o", "raw", "x", 5.0, "2026-01-01") for i in range(9)]))
    other = m.MemoryStore(spark, str(tmp_path / "m"))
    assert other.parts == 3 and [other.count(f"p{i}") for i in range(9)] == [1] * 9


def test_marks_made_during_a_change_survive(spark, tmp_path, monkeypatch):
    store = m.MemoryStore(spark, str(tmp_path / "m"), parts=1)
    store.add(adds(spark, [("p", "o", "raw", "a note", 5.0, "2026-01-01")]))
    other, write = m.MemoryStore(spark, str(tmp_path / "m")), m.MemoryStore._write
    for go in (lambda: store.add(adds(spark, [("p", "o", "raw", "another", 5.0, "2026-01-01")])), lambda: store.merge(whole=True)):
        day = f"2026-02-0{len(segments(store))}"

        def meanwhile(self, rows, day=day):
            out = write(self, rows)
            if self is store:
                assert [r.content for r in other.recall("p", "o", "a note", day, 1)] == ["a note"]
            return out

        monkeypatch.setattr(m.MemoryStore, "_write", meanwhile)
        go()
        monkeypatch.setattr(m.MemoryStore, "_write", write)
        assert {r.content: r.last_accessed for r in store.state().collect()}["a note"] == day


def test_two_writers(spark, tmp_path, monkeypatch):
    """The one who comes second makes its change anew, from what the first one left."""
    store = m.MemoryStore(spark, str(tmp_path / "m"), parts=2)
    store.add(adds(spark, [("p", "o", "raw", "a note", 5.0, "2026-01-01")]))
    other, write, done = m.MemoryStore(spark, str(tmp_path / "m")), m.MemoryStore._write, []

    def meanwhile(self, rows):
        out = write(self, rows)
        if self is store and not done:
            done.append(1)
            other.add(adds(spark, [("p", "o", "raw", "both add this", 3.0, "2026-01-02"), ("q", "o", "raw", "q", 3.0, "2026-01-02")]))
        return out

    monkeypatch.setattr(m.MemoryStore, "_write", meanwhile)
    store.add(adds(spark, [("p", "o", "raw", "both add this", 9.0, "2026-01-03"), ("r", "o", "raw", "r", 9.0, "2026-01-03")]))
    got = {(r.profile_id, r.content): (r.id, r.importance, r.last_accessed) for r in store.state().collect()}
    assert got["p", "both add this"] == (2, 3.0, "2026-01-03") and len({i for i, *_ in got.values()}) == 4 and len(got) == 4
    seen = store._manifest()
    store.delete(spark.createDataFrame([("p", "o", 1)], "profile_id string, owner string, id long"))
    with pytest.raises(m.Conflict):
        store._commit(lambda new: None, seen, [0, 1])


def test_numbers_are_taken_once(spark, tmp_path):
    store = m.MemoryStore(spark, str(tmp_path / "m"))
    assert store._put({"n": 0, "x": 1}) and not store._put({"n": 0, "x": 2})
    assert [f.name for f in (tmp_path / "m/manifest").iterdir() if not f.name.startswith(".")] == ["0.json"]
    assert store._manifest()["x"] == 1


def test_readers_and_writers_at_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(m.MemoryStore, "FAN", 2)
    path = str(tmp_path / "m")
    m.MemoryStore(spark, path, parts=2).add(adds(spark, [("p", "o", "core", "note 0", 5.0, "2026-01-01")]))
    stop, faults, seen = threading.Event(), [], []

    def read():
        while not stop.is_set():
            try:
                seen.append(m.MemoryStore(spark, path).count("p"))
            except Exception as e:
                faults.append(e)

    def write(who):
        try:
            for i in range(3):
                m.MemoryStore(spark, path).add(adds(spark, [("p", "o", "core", f"note {who} {i}", 5.0, "2026-01-01")]))
        except Exception as e:
            faults.append(e)

    reader, writers = threading.Thread(target=read), [threading.Thread(target=write, args=(w,)) for w in "ab"]
    for t in (reader, *writers):
        t.start()
    for t in writers:
        t.join()
    stop.set()
    reader.join()
    assert faults == [] and seen == sorted(seen) and seen
    got = m.MemoryStore(spark, path).state().collect()
    assert len(got) == 7 and len({r.id for r in got}) == 7


def test_marks_that_cannot_be_kept_do_not_lose_the_answer(spark, tmp_path, monkeypatch):
    store = m.MemoryStore(spark, str(tmp_path / "m"))
    store.add(adds(spark, [("p", "o", "raw", "a note", 5.0, "2026-01-01")]))
    monkeypatch.setattr(store, "_commit", lambda *a, **b: 1 / 0)
    with pytest.warns(UserWarning, match="marks are lost"):
        assert [r.content for r in store.recall("p", "o", "note", "2026-01-02")] == ["a note"]


class Model:
    """The store as one list of memories, changed at once."""

    def __init__(self):
        self.rows, self.last = {}, 0

    def find(self, key):
        return next((i for i, r in self.rows.items() if (r["p"], r["layer"], r["content"]) == key), None)

    def add(self, batch, day):
        for n, (p, layer, content) in enumerate(batch, 1):
            i = self.find((p, layer, content))
            if i is None:
                self.rows[self.last + n] = dict(p=p, layer=layer, content=content, at=day, d=1.0, a=False)
            else:
                self.rows[i]["at"] = day
        self.last += len(batch)

    def decay(self, day):
        n = 0
        for r in self.rows.values():
            if not r["a"]:
                r["d"] *= 0.5 ** (max((date.fromisoformat(day) - date.fromisoformat(r["at"])).days, 0) / m.HALF_LIFE[r["layer"]])
                if r["layer"] in m.FADING and r["d"] < m.ARCHIVE_BELOW:
                    r["a"] = True
                    n += 1
        return n


@pytest.mark.parametrize("fan, many", [(3, 64), (100, 2)])
def test_against_a_model(spark, tmp_path, monkeypatch, fan, many):
    """Adds, accesses, edits, deletions and decays in a random order, with merges between them."""
    monkeypatch.setattr(m.MemoryStore, "FAN", fan)
    monkeypatch.setattr(m.MemoryStore, "MANY", many)
    rng, model, store, start = random.Random(fan), Model(), m.MemoryStore(spark, str(tmp_path / "m"), parts=3), date(2026, 1, 1)
    for step in range(16):
        day = (start + timedelta(days=step * 6)).isoformat()
        kind = ("add", "decay", "recall", "edit", "delete")[0 if step < 2 else rng.choice([0, 0, 1, 1, 1, 2, 2, 3, 4])]
        if kind == "add":
            batch = [(f"p{rng.randrange(3)}", rng.choice(m.LAYERS), f"note {rng.randrange(8)}") for _ in range(6)]
            store.add(adds(spark, [(p, "o", layer, c, 5.0, day) for p, layer, c in batch]))
            model.add(batch, day)
        elif kind == "decay":
            assert store.apply_decay(day) == model.decay(day)
        elif kind == "recall":
            for r in store.recall("p1", "o", "note 1", day, 3):
                model.rows[r["id"]]["at"] = day
        elif model.rows:
            i = rng.choice(sorted(model.rows))
            change = spark.createDataFrame([(1, model.rows[i]["p"], "o", i, f"edited {step}")], "seq long, profile_id string, owner string, id long, content string")
            if kind == "edit":
                store.edit(change)
                model.rows[i]["content"] = f"edited {step}"
            else:
                store.delete(change)
                del model.rows[i]
    store.merge()
    got = {r.id: (r.profile_id, r.layer, r.content, r.last_accessed, round(r.decay_score, 9), r.archived) for r in store.state().collect()}
    assert got == {i: (r["p"], r["layer"], r["content"], r["at"], round(r["d"], 9), r["a"]) for i, r in model.rows.items()}
    assert len(store._manifest()["epochs"]) <= many


def test_changes_are_worked_out_once(spark, tmp_path):
    """Edits and deletions may be the outcome of a fold of the whole store, so a change reads them once."""
    store = m.MemoryStore(spark, str(tmp_path / "once"))
    store.add(adds(spark, [("p", "o", "raw", f"text {i}", 3.0, "2026-01-01") for i in range(6)]))
    for act, n in ((store.edit, 4), (store.delete, 2)):
        seen = spark.sparkContext.accumulator(0)

        def counted(batches, seen=seen):
            for b in batches:
                seen.add(b.num_rows)
                yield b

        change = spark.createDataFrame([(i, "p", "o", i, f"new {i}") for i in range(1, n + 1)], "seq long, profile_id string, owner string, id long, content string")
        act(change.mapInArrow(counted, change.schema))
        assert seen.value == n
    assert sorted(r.content for r in store.state().collect()) == ["new 3", "new 4", "text 4", "text 5"]
    assert not list((tmp_path / "once" / "work").iterdir())
