"""The account of a chat database against one that is kept in Python, with faults of each kind put in."""

import random
import sqlite3
from collections import Counter

from pyspark.sql import functions as F

from threadloom.operators import inventory
from threadloom.sources import chatdb


def brute(source, emitted, errors):
    """Rows of the account from the contract, by dictionaries."""
    ids = {r[0] for r in source["message"]}
    said = Counter(e[0] for e in emitted if e[0] is not None)
    bad = Counter(e for e in errors if e is not None)
    out = []
    for m in ids | set(said) | set(bad):
        n = said[m] + bad[m]
        out.append(("message", m, m, None, *(("unfounded", "MESSAGE_WITHOUT_SOURCE") if m not in ids else ("lost", "MESSAGE_LOST") if not n else ("doubled", "MESSAGE_TWICE") if n > 1 else ("error", None) if bad[m] else ("emitted", None))))
    pairs = {(e[0], c[1]) for e in emitted if e[0] is not None for c in e[2] or [] if c[1] is not None}
    seen = set()
    for rid, m, c in sorted(source["chat_message_join"]):
        if m is None or c is None:
            out.append(("chat_message_join", rid, m, c, "unsupported", "ID_MISSING"))
        elif m not in ids:
            out.append(("chat_message_join", rid, m, c, "unsupported", "MESSAGE_MISSING"))
        elif (m, c) in seen:
            out.append(("chat_message_join", rid, m, c, "duplicate", "SAME_RELATION"))
        else:
            seen.add((m, c))
            out.append(("chat_message_join", rid, m, c, *(("emitted", None) if (m, c) in pairs else ("error", None) if bad[m] else ("lost", "CONVERSATION_LOST"))))
    out += [("chat_message_join", None, m, c, "unfounded", "CONVERSATION_WITHOUT_SOURCE") for m, c in pairs - seen]
    alone = ids - {m for m, _ in seen}
    own = {e[0] for e in emitted if e[0] is not None for k, c in e[2] or [] if c is None and k == f"orphan:{e[0]}"}
    for m in alone | own:
        out.append(("orphan", None, m, None, *(("unfounded", "ORPHAN_WITHOUT_SOURCE") if m not in alone else ("emitted", None) if m in own else ("error", None) if bad[m] else ("lost", "ORPHAN_LOST"))))
    out += [("record", None, e[0], None, "unfounded", "PRIMARY_CONVERSATION_DIFFERS") for e in emitted if e[0] is not None and e[2] and e[1] != e[2][0][0]]
    held = {r[0] for r in source["attachment"]}
    have = Counter((e[0], a) for e in emitted if e[0] is not None for a in e[3] or [] if a is not None)
    used, sound, nth = set(), set(), Counter()
    for rid, m, a in sorted(source["message_attachment_join"]):
        used.add(a)
        if m is None or a is None:
            out.append(("message_attachment_join", rid, m, a, "unsupported", "ID_MISSING"))
        elif m not in ids:
            out.append(("message_attachment_join", rid, m, a, "unsupported", "MESSAGE_MISSING"))
        elif a not in held:
            out.append(("message_attachment_join", rid, m, a, "unsupported", "ATTACHMENT_MISSING"))
        else:
            sound.add(a)
            nth[m, a] += 1
            out.append(("message_attachment_join", rid, m, a, *(("emitted", None) if nth[m, a] <= have[m, a] else ("error", None) if bad[m] and not said[m] else ("lost", "ATTACHMENT_LOST"))))
    out += [("message_attachment_join", None, *p, "unfounded", "ATTACHMENT_WITHOUT_SOURCE") for p, n in have.items() for _ in range(n - nth[p])]
    out += [("attachment", a, None, None, "unsupported", "ONLY_UNSUPPORTED_LINKS" if a in used else "NO_LINK") for a in held - sound]
    return Counter(out)


def frames(spark, source, emitted, errors):
    schema = {"message": "ROWID bigint", "chat_message_join": "ROWID bigint, message_id bigint, chat_id bigint", "attachment": "ROWID bigint", "message_attachment_join": "ROWID bigint, message_id bigint, attachment_id bigint"}
    return (
        {t: spark.createDataFrame(sorted(rows), schema[t]) for t, rows in source.items()},
        spark.createDataFrame(emitted, "message_id bigint, conversation_id string, conversations array<struct<key:string,chat_id:bigint>>, attachments array<bigint>"),
        spark.createDataFrame([(e,) for e in errors], "message_id bigint"),
    )


def test_every_row_is_explained(spark):
    rng = random.Random(4)
    maybe = lambda x, p=0.06: None if rng.random() < p else x
    source = {
        "message": [(i,) for i in range(1, 80)], "attachment": [(i,) for i in range(1, 30)],
        "chat_message_join": [(i, maybe(rng.randint(1, 84)), maybe(rng.randint(1, 6))) for i in range(1, 110)],
        "message_attachment_join": [(i, maybe(rng.randint(1, 84)), maybe(rng.randint(1, 33))) for i in range(1, 60)],
    }
    source["message_attachment_join"] += [(100 + i, m, a) for i, (_, m, a) in enumerate(source["message_attachment_join"][:9])]
    emitted, errors = [], []
    for (m,) in source["message"]:
        chats = sorted({c for _, x, c in source["chat_message_join"] if x == m and c is not None})
        named = [(f"c{c}", c) for c in chats if rng.random() > 0.08] + ([("c99", 99)] if rng.random() < 0.05 else [])
        if (not chats and rng.random() > 0.2) or rng.random() < 0.05:
            named.append((f"orphan:{m}", None))
        files = [a for _, x, a in source["message_attachment_join"] if x == m and a is not None and a < 30 and rng.random() > 0.1] + ([7] if rng.random() < 0.05 else [])
        row = (m, "other" if rng.random() < 0.05 else named[0][0] if named else None, named or None, files or None)
        kind = rng.random()
        emitted += [] if kind < 0.08 else [row] * (2 if kind > 0.95 else 1)
        errors += [m] if kind < 0.05 or 0.5 < kind < 0.53 else []
    emitted += [(500, "x", [("x", 3)], [1]), (None, None, None, None)]
    errors += [600, None]
    got = inventory.source_account(*frames(spark, source, emitted, errors))
    want = brute(source, emitted, errors)
    assert Counter(map(tuple, got.collect())) == want
    assert {r[4] for r in want} == {"emitted", "error", "duplicate", "unsupported", "lost", "unfounded", "doubled"}
    assert {r[5] for r in want} == {None, "MESSAGE_LOST", "MESSAGE_TWICE", "MESSAGE_WITHOUT_SOURCE", "ID_MISSING", "MESSAGE_MISSING", "SAME_RELATION", "CONVERSATION_LOST", "CONVERSATION_WITHOUT_SOURCE", "ORPHAN_LOST", "ORPHAN_WITHOUT_SOURCE", "PRIMARY_CONVERSATION_DIFFERS", "ATTACHMENT_LOST", "ATTACHMENT_WITHOUT_SOURCE", "ATTACHMENT_MISSING", "NO_LINK", "ONLY_UNSUPPORTED_LINKS"}
    summary = {(r.table_name, r.outcome, r.reason): (r.n, r.ok) for r in inventory.account_summary(got).collect()}
    assert sum(n for n, _ in summary.values()) == sum(want.values()) and not summary["message", "lost", "MESSAGE_LOST"][1] and summary["message", "emitted", None][1]
    none = {t: [] for t in source}
    assert inventory.source_account(*frames(spark, none, [], [])).count() == 0


def test_a_database_read_by_ranges(spark, tmp_path):
    path = str(tmp_path / "chat.db")
    with sqlite3.connect(path) as db:
        db.executescript("CREATE TABLE message (ROWID INTEGER PRIMARY KEY, guid TEXT, text TEXT, handle_id INT, date INT, is_from_me INT, service TEXT); CREATE TABLE chat (ROWID INTEGER PRIMARY KEY, guid TEXT); CREATE TABLE chat_message_join (chat_id INT, message_id INT)")
        db.executemany("INSERT INTO message (ROWID, guid, text) VALUES (?, ?, ?)", [(i, f"g{i}", f"t{i}") for i in [*range(1, 300), 4000, -5]])
        db.executemany("INSERT INTO chat VALUES (?, ?)", [(1, "a"), (2, "b")])
        db.executemany("INSERT INTO chat_message_join VALUES (?, ?)", [(1 + i % 2, i) for i in range(1, 290)] + [(1, 2), (1, 2), (2, None)])
    spark.dataSource.register(chatdb.SqliteSource)
    rows = spark.read.format("sqlite_table").options(path=path, table="message", rows="40").load()
    assert sorted(r.ROWID for r in rows.collect()) == [-5, *range(1, 300), 4000] and 8 <= rows.rdd.getNumPartitions() <= 10
    # What the database's own records are made of leaves nothing unexplained.
    t = chatdb.tables(spark, path)
    records = chatdb.records(t)
    emitted = records.selectExpr("message_id", "conversations[0].conversation_key AS conversation_id", "transform(conversations, c -> struct(c.conversation_key AS key, c.chat_id AS chat_id)) AS conversations", "transform(attachments, a -> a.attachment_id) AS attachments")
    account = inventory.source_account(t, emitted, spark.createDataFrame([], "message_id bigint"))
    assert account.where("outcome IN ('lost', 'unfounded', 'doubled')").count() == 0
    assert {(r.outcome, r.reason): r.n for r in inventory.account_summary(account).where("table_name = 'chat_message_join'").collect()} == {("emitted", None): 289, ("duplicate", "SAME_RELATION"): 2, ("unsupported", "ID_MISSING"): 1}


def test_rows_are_dealt_over_as_many_tasks_as_they_need(spark, monkeypatch):
    """Bytes of ids are few, and AQE would give all of them to one task, whose sorts hold them all."""
    monkeypatch.setattr(inventory, "TASK_ROWS", 1000)
    ids = spark.range(3500).select(F.col("id").alias("ROWID"))
    links = ids.select("ROWID", F.col("ROWID").alias("message_id"), (F.col("ROWID") % 50).alias("chat_id"))
    emitted = links.select("message_id", F.lit("c").alias("conversation_id"), F.array(F.struct(F.lit("c").alias("key"), "chat_id")).alias("conversations"))
    account = inventory.conversation_account(ids, links, emitted, ids.limit(0).select(F.col("ROWID").alias("message_id"))).where("table_name = 'chat_message_join' AND outcome = 'emitted'")
    held = [r["count"] for r in account.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(held) == 3500 and max(held) < 1000
