import io
import json
import random
import zipfile

import pytest

from sparkloom.sources import readers as r


def put(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text, encoding="utf-8") if isinstance(text, str) else p.write_bytes(text)
    return str(p)


def test_telegram(spark, tmp_path):
    doc = {"messages": [
        {"type": "service", "from": "Ada", "text": "joined"},
        {"type": "message", "from": "Ada", "from_id": "u1", "date_unixtime": "100", "text": ["see ", {"type": "link", "text": "this"}, {"type": "b", "_text": "!", "text": "no"}]},
        {"type": "message", "actor": "Bo", "date": "2026-01-01T00:00:00", "text": "[plain"},
        {"type": "message", "from": "Ada", "text": "  "},
        {"type": "message", "text": "late"},
    ]}
    got = r.import_file(spark, put(tmp_path, "t.json", json.dumps(doc)), self_names={"Ada"}).orderBy("ord").collect()
    assert [(m.ts, m.sender_id, m.sender_name, m.direction, m.content, m.source) for m in got] == [
        ("100", "u1", "Ada", "self", "see this!", "telegram"), ("2026-01-01T00:00:00", "Bo", "Bo", "other", "[plain", "telegram"), ("4", "unknown", "unknown", "other", "late", "telegram"),
    ]


def test_jsonl(spark, tmp_path):
    text = '{"sender_name":"Ada","content":"hi"}\n\nnot json\n[1]\n{"sender":"Bo","content":"yo","direction":"self","ts":0,"type":"voice"}\n{"content":" "}\n{"content":"x","ts":7}'
    got = r.import_file(spark, put(tmp_path, "m.jsonl", text), self_names=["Ada"]).orderBy("ord").collect()
    assert [(m.ts, m.sender_name, m.direction, m.content, m.type) for m in got] == [("1", "Ada", "self", "hi", "text"), ("5", "Bo", "self", "yo", "voice"), ("7", "unknown", "other", "x", "text")]


def test_csv(spark, tmp_path):
    text = '﻿sender,content,ts\nAda,"two\nlines, ""q""",\nBo,,5\nBo,ok,9\n'
    got = r.import_file(spark, put(tmp_path, "m.csv", text), self_names=["Ada"]).orderBy("ord").collect()
    assert [(m.ord, m.ts, m.sender_name, m.direction, m.content) for m in got] == [(1, "1", "Ada", "self", 'two\nlines, "q"'), (3, "9", "Bo", "other", "ok")]
    with pytest.raises(r.ImportFailed, match="sender and content"):
        r.import_file(spark, put(tmp_path, "bad.csv", "who,content\na,b\n"))


def test_lines_are_numbered_across_blocks(spark, tmp_path):
    """Files cut into blocks of some bytes, small ones read together, and every end of line."""
    rng = random.Random(1)
    texts = ["".join(rng.choice(["a", "é" * 9, "word " * 7, "\n", "\r\n", "\r", "\x0b", "\u2028", "\x85"]) for _ in range(n)) for n in (400, 3, 0, 900)]
    d = tmp_path / "lines"
    d.mkdir()
    for i, t in enumerate(texts):
        (d / f"{i}.jsonl").write_bytes(t.encode())
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("200b", "1m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = {}
            for x in r.numbered_lines(spark, str(d)).collect():
                got.setdefault(x.path.rsplit("/", 1)[1], []).append((x.n, x.line))
            for i, t in enumerate(texts):
                want, have = list(enumerate(t.splitlines(), 1)), sorted(got.get(f"{i}.jsonl", []))
                assert have == want + [(len(want) + 1, "")] * (t.endswith(("\x0b", "\u2028", "\x85")))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_records_are_numbered_in_each_file(spark, tmp_path):
    d = tmp_path / "records"
    d.mkdir()
    for i in range(4):
        (d / f"{i}.csv").write_text('sender,content\nAda,"two\nlines"\nBo,\nBo,x\n')
    got = r.read_csv(spark, str(d)).collect()
    assert sorted((m.ord, m.ts, m.content) for m in got) == sorted([(1, "1", "two\nlines"), (3, "3", "x")] * 4)


def test_memotrace(spark, tmp_path):
    items = [{"type": "1", "content": "a", "talker": "Ada", "StrTime": "t", "is_sender": 0}, {"type": 3, "msg": "pic", "sender": "Bo", "is_sender": 1}, {"message": "c", "sender_name": "Ada", "ts": 12}, {"content": ""}, 5]
    want = [("t", "Ada", "other", "a", "text"), ("1", "Bo", "self", "pic", "media"), ("12", "Ada", "self", "c", "text")]
    for doc in (items, {"data": items}, {"messages": [], "data": items}):
        got = r.import_file(spark, put(tmp_path, "w.json", json.dumps(doc)), "memotrace", ["Ada"]).orderBy("ord").collect()
        assert [(m.ts, m.sender_name, m.direction, m.content, m.type) for m in got] == want
    with pytest.raises(r.ImportFailed):
        r.import_file(spark, put(tmp_path, "o.json", '{"data": {"a": 1}}'), "memotrace")


def test_errors_and_sniffing(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        r.import_file(spark, str(tmp_path / "none.json"))
    with pytest.raises(r.ImportFailed, match="no message"):
        r.import_file(spark, put(tmp_path, "e.jsonl", "\n"))
    with pytest.raises(r.ImportFailed, match="extension"):
        r.import_file(spark, put(tmp_path, "n.txt", "x"))
    with pytest.raises(r.ImportFailed, match="unknown source"):
        r.import_file(spark, put(tmp_path, "e.jsonl", "\n"), "fax")
    assert [r.sniff_format(p) for p in ("a/b.JSON", "x.csv", "n.txt", "n.epub")] == ["chat", "chat", "novel", "novel"]
    for bad, why in (("a.docx", ".docx"), ("d.x/none", "no extension")):
        with pytest.raises(ValueError, match=why):
            r.sniff_format(bad)


def test_inspect(spark, tmp_path):
    text = "\n".join(json.dumps({"sender": s, "content": c}) for s, c in [("Bo", "x"), ("Ada", "one one"), ("Ada", "y" * 80), ("Bo", " two "), ("Ada", "z"), ("Ada", "three"), ("Ada", "four")])
    got = r.inspect_file(spark, put(tmp_path, "m.jsonl", text))
    assert got["total"] == 7 and got["format"] == ".jsonl"
    assert got["senders"] == [{"name": "Ada", "count": 5, "samples": ["one one", "y" * 60, "three"]}, {"name": "Bo", "count": 2, "samples": ["two"]}]
    telegram = {"messages": [{"type": "message", "from": "Ada", "text": "hey"}]}
    assert r.inspect_file(spark, put(tmp_path, "t.json", json.dumps(telegram)))["total"] == 1
    with pytest.raises(ValueError):
        r.inspect_file(spark, put(tmp_path, "n.txt", "x"))


def test_novels(spark, tmp_path):
    d = tmp_path / "books"
    d.mkdir()
    (d / "a.txt").write_bytes(b"  One \xff\n\n two\n")
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("c10.xhtml", '<html xmlns="http://www.w3.org/1999/xhtml"><head><title>T10</title></head><body><p>ten <b>bold</b> tail</p></body></html>')
        z.writestr("c2.xhtml", "<html><body><h1>Two</h1><div>  d </div></body></html>")
        z.writestr("bad.html", "<p>never closed")
    (d / "b.epub").write_bytes(buf.getvalue())
    got = {x.path.rsplit("/", 1)[1]: x.text for x in r.read_novels(spark, str(d)).collect()}
    assert got == {"a.txt": "One\ntwo", "b.epub": "T10\nten\nTwo\nd"}
    assert r.epub_text(buf.getvalue(), natural=True).startswith("Two")


def test_relabel(spark, tmp_path):
    m = r.import_file(spark, put(tmp_path, "m.jsonl", '{"sender":"Ada","content":"a"}\n{"sender":"Bo","content":"b"}'))
    assert [x.direction for x in r.relabel(m, "Bo").orderBy("ord").collect()] == ["other", "self"]
