import hashlib
import sqlite3

import pytest
from pyspark.sql import functions as F

from threadloom.sources import attachments, chatdb, staging, structured, text


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿Message ID;Date;From;Message\n1;2024-01-01T00:00:00Z;Ann;"two\nlines"\n2;2024-01-01 10:00;;x\n', encoding="utf-8")
    rows = structured.read_csv(spark, str(tmp_path / "a.csv")).orderBy("source_message_id").collect()
    assert [(r.text, r.sender, r.timestamp_precision) for r in rows] == [("two\nlines", "Ann", "second"), ("x", None, "local_text")]
    assert rows[0].timestamp_us == 1_704_067_200_000_000


def test_json(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"messages": [{"id": "1", "text": "a"}, {"id": "2", "text": null}]}')
    (tmp_path / "b.jsonl").write_text('{"id": "1", "body": "a"}\n\n{"id": "2", "body": "b"}\n')
    assert structured.read_json(spark, str(tmp_path / "a.json"), False).count() == 2
    assert {r.text for r in structured.read_json(spark, str(tmp_path / "b.jsonl"), True).collect()} == {"a", "b"}
    (tmp_path / "c.jsonl").write_text("not json\n")
    with pytest.raises(Exception):  # noqa: B017
        structured.read_json(spark, str(tmp_path / "c.jsonl"), True).collect()


def test_text(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\r\n\r\ntwo\nthree\n")
    read = lambda mode: [(r.ordinal, r.text) for r in text.read_text(spark, str(tmp_path / "a.txt"), mode).orderBy("ordinal").collect()]
    assert read("line") == [(1, "one"), (3, "two"), (4, "three")] and [t for _, t in read("block")] == ["one", "two\nthree\n"] and len(read("whole")) == 1


def test_detect(spark, tmp_path):
    sqlite3.connect(tmp_path / "x.db").execute("CREATE TABLE t (a)").connection.close()
    (tmp_path / "y.csv").write_text("a")
    (tmp_path / "z.bin").write_text("a")
    kinds = {r.path.rsplit("/", 1)[1]: r.kind for r in structured.detect(spark.read.format("binaryFile").load(str(tmp_path))).collect()}
    assert kinds == {"x.db": "sqlite", "y.csv": "csv", "z.bin": "unknown"}


def test_chat_database(spark, tmp_path):
    db = sqlite3.connect(tmp_path / "chat.db")
    db.executescript(
        """CREATE TABLE message (guid TEXT, text TEXT, attributedBody BLOB, handle_id INT, date INT, is_from_me INT, service TEXT);
        CREATE TABLE handle (id TEXT); CREATE TABLE chat (guid TEXT); CREATE TABLE chat_message_join (chat_id INT, message_id INT); CREATE TABLE chat_handle_join (chat_id INT, handle_id INT);
        INSERT INTO handle VALUES ('+1'); INSERT INTO chat VALUES ('c1'), (NULL); INSERT INTO message VALUES ('m1', 'hi', NULL, 1, 0, 0, 'SMS'), ('m2', NULL, x'4e53537472696e672b026f6b', NULL, 600000000000000000, 1, 'SMS');
        INSERT INTO chat_message_join VALUES (2, 1), (1, 1), (1, 1); INSERT INTO chat_handle_join VALUES (1, 1);"""
    )
    db.commit()
    db.close()
    copy, sha = chatdb.snapshot(str(tmp_path / "chat.db"), str(tmp_path))
    assert len(sha) == 64
    rows = {r.message_id: r for r in chatdb.records(chatdb.tables(spark, copy)).collect()}
    assert [c.conversation_key for c in rows[1].conversations] == ["guid:c1", "rowid:2"] and rows[1].sender == "+1" and rows[1].timestamp_us == 978_307_200 * 10**6
    assert rows[2].text == "ok" and rows[2].conversations[0].conversation_key == "orphan:2" and rows[2].attachments is None and rows[2].timestamp_precision == "nanosecond"


def test_bundle(spark, tmp_path):
    df = spark.range(3).select(F.col("id"), F.lit("x").alias("text"))
    staging.write_bundle(df, f"file://{tmp_path}/b", "csv", "00")
    assert staging.read_bundle(spark, f"file://{tmp_path}/b", df.schema).count() == 3
    df.limit(1).write.mode("append").json(f"file://{tmp_path}/b/messages")
    with pytest.raises(ValueError, match="manifest says"):
        staging.read_bundle(spark, f"file://{tmp_path}/b", df.schema)


def test_published_runs(spark, tmp_path):
    path = f"file://{tmp_path}/p"
    staging.publish(spark.range(2), path, 1, "v")
    staging.publish(spark.range(4), path, 2, "v")
    staging.publish(spark.range(5), path, 2, "v")  # again: in place of the first
    spark.range(9).write.parquet(f"{path}/data/rows/run-3-{'0' * 32}")  # never completed
    assert sorted(map(tuple, staging.read_published(spark, path).collect())) == [(i, 2) for i in range(5)]


def test_long_bodies_are_whole():
    from threadloom.functions.body import decode

    assert decode(b"xxNSString+\x82" + (150_000).to_bytes(4, "little") + b"a" * 150_000) == "a" * 150_000


def test_what_a_file_is(spark, tmp_path):
    db = sqlite3.connect(tmp_path / "chat.db")
    db.executescript("PRAGMA journal_mode=WAL; CREATE TABLE message (date INT, is_from_me INT);")
    db.commit()
    db.execute("PRAGMA wal_checkpoint(TRUNCATE)")
    db.close()
    (tmp_path / "broken.db").write_bytes(structured.SQLITE_MAGIC + b"x" * 100)
    (tmp_path / "s.csv").write_text("﻿Chat Session;Message Text\n", encoding="utf-8")
    (tmp_path / "g.csv").write_text("Sent Date\tx\n")
    (tmp_path / "n.csv").write_text("a,b\n")
    for name in ("e.csv", "j.jsonl", "j.json", "t.txt", "none"):
        (tmp_path / name).write_text("\n")
    told = {r.path.rsplit("/", 1)[1]: (r.source_type, r.confidence, r.requires_explicit_mode) for r in structured.detect(spark.read.format("binaryFile").load(str(tmp_path))).collect()}
    assert told == {
        "chat.db": ("imessage_chat_db", "exact", False), "broken.db": ("unknown", "none", False), "s.csv": ("imazing_messages_csv", "high", False), "g.csv": ("generic_message_csv", "high", False), "n.csv": ("unknown", "none", False),
        "e.csv": ("unknown", "none", False), "j.jsonl": ("generic_message_jsonl", "extension", False), "j.json": ("generic_message_json", "extension", False), "t.txt": ("generic_message_text", "extension", True), "none": ("unknown", "none", False),
    }


def test_session_exports(spark, tmp_path):
    (tmp_path / "Ann Lee.csv").write_text('Chat Session,Sender Name,Sent Date,Message,Direction,Attachment,Mime type\nTeam,Ann,2024-01-01T00:00:00Z,"a\nb",In coming,,\n,,123,,Sent,x/y/p.png,image/png\n,,,,,,\n', encoding="utf-8")
    rows = structured.read_sessions_csv(spark, str(tmp_path), ",").orderBy("source_ordinal").collect()
    assert [(r.source_message_id, r.source_conversation_id, r.timestamp_precision, r.text, r.is_outgoing) for r in rows] == [("row:2", "Team", "second", "a\nb", False), ("row:3", "Ann Lee", "text", None, True), ("row:4", "Ann Lee", None, None, None)]
    assert [[tuple(a) for a in r.attachments] for r in rows] == [[], [("row:3:attachment:1", "p.png", "image/png", "x/y/p.png")], []]
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "b.csv").write_text("x,y\n1,2\n")
    with pytest.raises(ValueError):
        structured.read_sessions_csv(spark, str(tmp_path / "b"))


def test_rows_are_numbered_in_each_file(spark, tmp_path):
    for name in "ab":
        (tmp_path / f"{name}.csv").write_text("id,text\n" + "".join(f"{i},{name}\n" for i in range(3)))
    assert sorted((r.source_ordinal, r.source_message_id, r.text) for r in structured.read_csv(spark, str(tmp_path), ",").collect()) == [(i + 2, str(i), n) for i in range(3) for n in "ab"]


def test_best_table():
    good = ["ID", "Created_At", "body", "author"]
    assert structured.discover({"a": ["id", "text"], "b": good, "c": ["id", "date", "text"]}) == ("b", {"message_id": "ID", "sender": "author", "timestamp": "Created_At", "text": "body"})
    assert structured.discover({"z": good, "y": good})[0] == "y" and structured.discover({"a": good, "b": ["membership_id", "id", "date", "text"]})[0] == "b"
    for none in ({}, {"a": ["id", "text"]}):
        with pytest.raises(ValueError):
            structured.discover(none)


def test_attachment_files(spark, tmp_path):
    (tmp_path / "ab").mkdir()
    (tmp_path / "ab" / "p 1.png").write_bytes(b"png")
    (tmp_path / "q.txt").write_bytes(b"q")
    root = str(tmp_path)
    rows = [(1, "~/Library/Attachments/ab/p 1.png", None), (2, f"{root}/q.txt", "z"), (3, None, "ab\\p 1.png"), (4, "/else/q.txt", None), (5, "", None), (6, "attachments", None), (7, "./q.txt", None)]
    got = {r.attachment_id: r for r in attachments.resolve(spark.createDataFrame(rows, "attachment_id long, source_path string, filename string"), attachments.files(spark, root), root).collect()}
    assert {i: r.resolution_status for i, r in got.items()} == {1: "resolved", 2: "resolved", 3: "resolved", 4: "missing", 5: "no_path", 6: "missing", 7: "resolved"}
    assert got[1].sha256 == hashlib.sha256(b"png").hexdigest() and got[1].actual_bytes == 3 and got[4].sha256 is None


def test_report_file(spark, tmp_path):
    checks = spark.createDataFrame([("B", 0, "OK"), ("A", 2, "ERROR")], "code string, n long, severity string")
    digest = staging.write_report(checks, str(tmp_path / "r"))
    (text,) = [p.read_text() for p in (tmp_path / "r").glob("part-*")]
    assert text == '{"checks":[{"code":"A","n":2,"severity":"ERROR"},{"code":"B","n":0,"severity":"OK"}],"status":"FAIL"}\n' and digest == hashlib.sha256(text.strip().encode()).hexdigest()
