"""A canonical store with planted faults over the events, the audits and views of it, and their SQL.

The tables are SQL that Spark and DuckDB both run; what the operators do with them is written again for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import integrity as ig
from ..operators import structure as st
from ..operators import views as vw
from . import adapters as ad

TABLES = {
    "conversation": "SELECT DISTINCT CAST(floor(user_id / 2) AS BIGINT) AS conversation_id FROM events",
    "message": "SELECT event_id AS message_id, CASE WHEN event_id % 503 = 0 THEN -1 ELSE CAST(floor(user_id / 2) AS BIGINT) END AS conversation_id FROM events",
    "membership": """SELECT event_id AS membership_id, event_id AS message_id, CAST(floor(user_id / 2) AS BIGINT) AS conversation_id, true AS is_primary FROM events WHERE event_id % 501 <> 0
      UNION ALL SELECT event_id + 1000000000, event_id, CAST(floor(user_id / 2) AS BIGINT) + 1000, event_id % 80 = 0 FROM events WHERE event_id % 40 = 0""",
    "import_run": """SELECT CAST(1 AS BIGINT) AS import_run_id, 'csv' AS source_type, 'aa' AS source_sha256, 'f1' AS source_fingerprint, '0.1' AS parser_version UNION ALL SELECT CAST(2 AS BIGINT), 'json', CAST(NULL AS VARCHAR(9)), 'f2', '0.2'""",
    "message_source": """SELECT event_id AS message_source_id, CASE WHEN event_id % 509 = 0 THEN event_id + 2000000000 ELSE event_id END AS message_id, CAST(1 + event_id % 2 AS BIGINT) AS import_run_id, CASE WHEN event_id % 2 = 0 AND event_id % 521 <> 0 THEN 'csv' ELSE 'json' END AS source_type,
      concat('k', CAST(event_id AS VARCHAR(20))) AS source_record_key, CASE WHEN event_id % 3 <> 0 THEN concat('c', CAST(CAST(floor(user_id / 2) AS BIGINT) AS VARCHAR(20))) END AS source_conversation_id FROM events WHERE event_id % 523 <> 0""",
    "conversation_source": """SELECT conversation_id AS conversation_source_id, CASE WHEN conversation_id % 29 = 0 THEN conversation_id + 1 ELSE conversation_id END AS conversation_id, CAST(1 AS BIGINT) AS import_run_id, CASE WHEN conversation_id % 31 = 0 THEN 'json' ELSE 'csv' END AS source_type,
      CASE WHEN conversation_id % 37 = 0 THEN 'bb' WHEN conversation_id % 2 = 0 THEN 'aa' END AS source_sha256, concat('c', CAST(conversation_id AS VARCHAR(20))) AS source_conversation_id FROM (SELECT DISTINCT CAST(floor(user_id / 2) AS BIGINT) AS conversation_id FROM events) AS c""",
    "source_membership": """SELECT event_id AS message_source_id, CASE WHEN event_id % 541 = 0 THEN event_id + 1 ELSE event_id END AS membership_id, CAST(floor(user_id / 2) AS BIGINT) AS conversation_source_id, CAST(0 AS BIGINT) AS position FROM events WHERE event_id % 547 <> 0""",
    "attachment": "SELECT event_id AS attachment_id, concat('s', CAST(event_id AS VARCHAR(20))) AS sha256, CASE WHEN event_id % 4 <> 0 THEN event_type END AS mime_type FROM events WHERE event_id % 10 = 0",
    "occurrence": "SELECT event_id AS occurrence_id, event_id AS message_id, CASE WHEN event_id % 70 = 0 THEN event_id + 10 ELSE event_id END AS attachment_id, CAST(0 AS BIGINT) AS position FROM events WHERE event_id % 10 = 0",
    "message_attachment": "SELECT event_id AS message_id, event_id AS attachment_id FROM events WHERE event_id % 10 = 0",
    "attachment_source": """SELECT event_id AS attachment_source_id, event_id AS attachment_id, CASE WHEN event_id % 130 <> 0 THEN event_id END AS occurrence_id, CAST(1 AS BIGINT) AS import_run_id, CASE WHEN event_id % 260 <> 0 THEN concat('o', CAST(event_id AS VARCHAR(20))) END AS source_occurrence_key FROM events WHERE event_id % 10 = 0 AND event_id % 110 <> 0""",
}


def store(spark, sf_dir: str) -> ig.Store:
    events = ad.table(spark, sf_dir, "events")
    return {name: spark.sql(sql.replace("FROM events", "FROM {events}"), events=events) for name, sql in TABLES.items()}


def store_integrity(spark, sf_dir: str) -> DataFrame:
    return ig.store_report(store(spark, sf_dir))


def attachment_view(spark, sf_dir: str) -> DataFrame:
    s = store(spark, sf_dir)
    return vw.analysis_attachments(s["occurrence"], s["attachment"])


def message_source_view(spark, sf_dir: str) -> DataFrame:
    s = store(spark, sf_dir)
    return vw.analysis_message_sources(s["message_source"], s["import_run"])


def membership_view(spark, sf_dir: str) -> DataFrame:
    s = store(spark, sf_dir)
    return vw.analysis_memberships(s["membership"], s["source_membership"], s["conversation_source"])


def attachment_source_view(spark, sf_dir: str) -> DataFrame:
    s = store(spark, sf_dir)
    return vw.analysis_attachment_sources(s["attachment_source"], s["import_run"], s["occurrence"])


def provenance_view(spark, sf_dir: str) -> DataFrame:
    s = store(spark, sf_dir)
    i = F.col("message_id")
    replies = s["message"].where("message_id % 6 = 0").select(i.alias("relation_id"), i.alias("source_message_id"), (i - 1).alias("target_message_id"), F.lit("reply_to").alias("relation_type"))
    replies = replies.union(s["message"].where("message_id % 12 = 0").select((-i).alias("relation_id"), i, i - 2, F.lit("Reply")))
    rows = vw.message_provenance(s["message"], replies, vw.analysis_attachments(s["occurrence"], s["attachment"]), s["message_source"], s["import_run"])
    return rows.select("message_id", "reply_to", *[F.array_join(c, ",").alias(c) for c in rows.columns if c.endswith("s")])


def vertical_reconciliation(spark, sf_dir: str) -> DataFrame:
    e = ad.table(spark, sf_dir, "events").where("event_id % 527 <> 0")
    i = F.col("event_id")
    staged = e.select(F.concat(F.lit("k"), i.cast("string")).alias("source_record_key"), F.when(i % 10 == 0, 1).when(i % 601 == 0, 2).otherwise(0).alias("n_attachments"), F.when(i % 607 == 0, 3).otherwise(1).alias("n_conversations"))
    return ig.vertical(staged.union(staged.where("source_record_key = 'k7'")), store(spark, sf_dir))


def evidence_drift(spark, sf_dir: str) -> DataFrame:
    m = ad.sparse(spark, sf_dir)
    i = F.col("message_id")
    taken = m.select(F.when(i % 31 == 0, -i).otherwise(i).alias("message_id"), F.when(i % 37 == 0, None).when(i % 41 == 0, F.sha2(F.lit("old"), 256)).otherwise(F.sha2("text", 256)).alias("text_sha256"), F.when(i % 43 == 0, F.col("timestamp_us") + 1).otherwise(F.col("timestamp_us")).alias("timestamp_us"))
    return ig.evidence_drift(taken, m)


def resolution_audit(spark, sf_dir: str) -> DataFrame:
    p = ad.people(spark, sf_dir)
    i = F.col("participant_id")
    told = st.resolved_participants(p).where("participant_id % 7 <> 0").withColumn("resolved_id", F.when(i % 11 == 0, i + 1).otherwise(F.col("resolved_id")))
    return ig.resolution_oracle(p, told.select("participant_id", "resolved_id").union(spark.sql("SELECT -5L, -5L")))


def context_warnings(spark, sf_dir: str) -> DataFrame:
    return ig.context_warnings(ad.sparse(spark, sf_dir), store(spark, sf_dir)["message_source"])


def resolved_latest(spark, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    e = ad.table(spark, sf_dir, "events")
    rows = e.select((i % 3 + 1).cast("bigint").alias("run_id"), i.alias("membership_id"), F.col("user_id").alias("sender_id"))
    side = e.where("event_id % 5 <> 0").select((i % 3 + 1).cast("bigint").alias("run_id"), i.alias("membership_id"), (F.col("user_id") + 1).alias("resolved_sender_id"))
    return vw.resolved_latest(rows, side, spark.sql("SELECT 1L AS run_id, 'completed' AS status UNION ALL SELECT 2L, 'completed' UNION ALL SELECT 3L, 'failed'"))


def labelled_responses(spark, sf_dir: str) -> DataFrame:
    e = ad.table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("responder_id"), (F.col("user_id") + 3).alias("from_id"))
    return vw.labelled(e, ad.people(spark, sf_dir).where("participant_id % 9 <> 0"), ("responder_id", "from_id"))


def exact_targets(spark, sf_dir: str) -> DataFrame:
    p = ad.people(spark, sf_dir)
    labels = p.select(F.floor(F.col("participant_id") / 2).alias("conversation_id"), F.col("canonical_name").alias("label")).union(p.select(F.floor(F.col("participant_id") / 2), F.concat(F.lit("id  "), F.col("participant_id").cast("string"))))
    wanted = p.select(F.upper(F.concat(F.lit(" Id "), F.col("participant_id").cast("string"))).alias("label")).union(p.select("canonical_name").distinct())
    return ig.exact_targets(labels, wanted)


def last_messages(spark, sf_dir: str) -> DataFrame:
    return ig.last_messages(ad.sparse(spark, sf_dir), 5).select("conversation_id", "membership_id", "timestamp_us")


def store_fingerprint(spark, sf_dir: str) -> DataFrame:
    return ig.store_fingerprint(store(spark, sf_dir))


#: Columns of the tables in the order of their names.
COLUMNS = {
    "conversation": "conversation_id", "message": "conversation_id message_id", "membership": "conversation_id is_primary membership_id message_id", "import_run": "import_run_id parser_version source_fingerprint source_sha256 source_type",
    "message_source": "import_run_id message_id message_source_id source_conversation_id source_record_key source_type", "conversation_source": "conversation_id conversation_source_id import_run_id source_conversation_id source_sha256 source_type",
    "source_membership": "conversation_source_id membership_id message_source_id position", "attachment": "attachment_id mime_type sha256", "occurrence": "attachment_id message_id occurrence_id position", "message_attachment": "attachment_id message_id",
    "attachment_source": "attachment_id attachment_source_id import_run_id occurrence_id source_occurrence_key",
}


def _fingerprint(table: str) -> str:
    """A table's digest in SQL: sums of five parts of its rows' digests."""
    row = "sha256(to_json(struct_pack(" + ", ".join(f"{c} := {c}" for c in COLUMNS[table].split()) + "))::VARCHAR)"
    sums = ", ".join(f"coalesce(sum(('0x' || substring(h, {1 + 12 * i}, 12))::BIGINT), 0)::VARCHAR" for i in range(5))
    return f"SELECT '{table}' AS table_name, count(*) AS n, sha256(concat_ws(':', count(*)::VARCHAR, {sums})) AS fingerprint FROM (SELECT {row} AS h FROM {table})"


_WITH = "WITH " + ", ".join(f"{n} AS ({q})" for n, q in TABLES.items())
_RUN = "coalesce(source_sha256, 'fingerprint:' || source_fingerprint)"
_VIEWS = {
    "attachment_view": "SELECT occurrence_id, o.message_id, o.attachment_id, sha256, mime_type, position FROM occurrence o JOIN attachment a ON a.attachment_id = o.attachment_id",
    "message_source_view": f"SELECT s.message_id, s.source_type, {_RUN} AS source_snapshot_key, source_sha256, source_conversation_id, source_record_key, s.import_run_id FROM message_source s JOIN import_run r ON r.import_run_id = s.import_run_id",
    "membership_view": "SELECT m.membership_id, m.message_id, m.conversation_id, is_primary, message_source_id, l.conversation_source_id, c.source_type, c.source_sha256, c.source_conversation_id, position FROM membership m LEFT JOIN source_membership l ON l.membership_id = m.membership_id LEFT JOIN conversation_source c ON c.conversation_source_id = l.conversation_source_id",
    "attachment_source_view": f"SELECT attachment_source_id, s.attachment_id, s.occurrence_id, o.message_id, o.position, s.import_run_id, r.source_type, {_RUN} AS source_snapshot_key, parser_version, source_occurrence_key FROM attachment_source s JOIN import_run r ON r.import_run_id = s.import_run_id LEFT JOIN occurrence o ON o.occurrence_id = s.occurrence_id",
}
_CHECKS = {
    "MESSAGE_SOURCE_TRACE_MISSING": "message m WHERE NOT EXISTS (SELECT 1 FROM message_source x WHERE x.message_id = m.message_id)",
    "MESSAGE_CONVERSATION_MEMBERSHIP_MISSING": "message m WHERE NOT EXISTS (SELECT 1 FROM membership x WHERE x.message_id = m.message_id)",
    "MESSAGE_PRIMARY_MEMBERSHIP_COUNT_INVALID": "(SELECT m.message_id FROM message m LEFT JOIN membership x ON x.message_id = m.message_id GROUP BY 1 HAVING count(*) FILTER (WHERE x.is_primary) <> 1) q",
    "MESSAGE_PRIMARY_POINTER_MISMATCH": "message m WHERE NOT EXISTS (SELECT 1 FROM membership x WHERE x.message_id = m.message_id AND x.is_primary AND x.conversation_id = m.conversation_id)",
    "MESSAGE_SOURCE_CONVERSATION_TRACE_MISSING": "message_source s WHERE source_conversation_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM source_membership x WHERE x.message_source_id = s.message_source_id)",
    "MESSAGE_SOURCE_MEMBERSHIP_MESSAGE_MISMATCH": "source_membership l JOIN message_source s ON s.message_source_id = l.message_source_id JOIN membership m ON m.membership_id = l.membership_id WHERE s.message_id <> m.message_id",
    "SOURCE_MEMBERSHIP_CONVERSATION_MISMATCH": "source_membership l JOIN message_source s ON s.message_source_id = l.message_source_id JOIN conversation_source c ON c.conversation_source_id = l.conversation_source_id JOIN membership m ON m.membership_id = l.membership_id WHERE c.conversation_id <> m.conversation_id",
    "MESSAGE_SOURCE_IMPORT_TYPE_MISMATCH": "message_source s JOIN import_run r ON r.import_run_id = s.import_run_id WHERE s.source_type <> r.source_type",
    "CONVERSATION_SOURCE_IMPORT_TYPE_MISMATCH": "conversation_source s JOIN import_run r ON r.import_run_id = s.import_run_id WHERE s.source_type <> r.source_type",
    "CONVERSATION_SOURCE_SHA_MISMATCH": "conversation_source s JOIN import_run r ON r.import_run_id = s.import_run_id WHERE s.source_sha256 <> r.source_sha256",
    "ATTACHMENT_SOURCE_TRACE_MISSING": "attachment a WHERE attachment_id NOT IN (SELECT attachment_id FROM attachment_source)",
    "ATTACHMENT_OCCURRENCE_BLOB_MAPPING_MISSING": "occurrence o WHERE NOT EXISTS (SELECT 1 FROM message_attachment x WHERE x.message_id = o.message_id AND x.attachment_id = o.attachment_id)",
    "ATTACHMENT_OCCURRENCE_SOURCE_TRACE_MISSING": "occurrence o WHERE NOT EXISTS (SELECT 1 FROM attachment_source x WHERE x.occurrence_id = o.occurrence_id)",
    "ATTACHMENT_SOURCE_OCCURRENCE_MISMATCH": "attachment_source s JOIN occurrence o ON o.occurrence_id = s.occurrence_id WHERE s.attachment_id <> o.attachment_id",
    "ATTACHMENT_SOURCE_OCCURRENCE_LINK_MISSING": "attachment_source WHERE source_occurrence_key IS NOT NULL AND occurrence_id IS NULL",
}
_PARITY = {
    "ANALYSIS_MESSAGES_MEMBERSHIP_COUNT_MISMATCH": ("count(*) FROM membership JOIN message USING (message_id)", "count(*) FROM membership"),
    "ANALYSIS_MESSAGES_CANONICAL_COVERAGE_MISMATCH": ("count(DISTINCT message_id) FROM membership JOIN message USING (message_id)", "count(*) FROM message"),
    "ANALYSIS_CONVERSATIONS_COUNT_MISMATCH": ("count(*) FROM conversation", "count(*) FROM conversation"),
    "ANALYSIS_ATTACHMENTS_OCCURRENCE_COUNT_MISMATCH": (f"count(*) FROM ({_VIEWS['attachment_view']})", "count(*) FROM occurrence"),
    "ANALYSIS_MESSAGE_SOURCES_COUNT_MISMATCH": (f"count(*) FROM ({_VIEWS['message_source_view']})", "count(*) FROM message_source"),
    "ANALYSIS_MEMBERSHIP_COVERAGE_MISMATCH": (f"count(DISTINCT membership_id) FROM ({_VIEWS['membership_view']})", "count(*) FROM membership"),
}
_SEVERITY = "CASE WHEN n > 0 THEN 'ERROR' ELSE 'OK' END AS severity"


def _issues(counts: dict[str, str]) -> str:
    return f"SELECT code, n, {_SEVERITY} FROM (" + " UNION ALL ".join(f"SELECT '{code}' AS code, ({sql})::BIGINT AS n" for code, sql in counts.items()) + ")"


QUERIES = {f.__name__: f for f in (store_integrity, attachment_view, message_source_view, membership_view, attachment_source_view, provenance_view, vertical_reconciliation, evidence_drift, resolution_audit, context_warnings, resolved_latest, labelled_responses, exact_targets, last_messages, store_fingerprint)}
ORACLES = {
    "store_integrity": f"{_WITH} " + _issues({**{c: f"SELECT count(*) FROM {q}" for c, q in _CHECKS.items()}, **{c: f"SELECT CASE WHEN (SELECT {a}) = (SELECT {b}) THEN 0 ELSE 1 END" for c, (a, b) in _PARITY.items()}}),
    **{n: f"{_WITH} {q}" for n, q in _VIEWS.items()},
    "provenance_view": f"""{_WITH}, rel AS (SELECT event_id AS rid, event_id AS s, event_id - 1 AS t FROM events WHERE event_id % 6 = 0 UNION ALL SELECT -event_id, event_id, event_id - 2 FROM events WHERE event_id % 12 = 0),
      r AS (SELECT s AS message_id, t AS reply_to FROM rel QUALIFY row_number() OVER (PARTITION BY s ORDER BY rid, t) = 1), k AS (SELECT message_id, string_agg(DISTINCT mime_type, ',' ORDER BY mime_type) AS mime_types FROM ({_VIEWS['attachment_view']}) WHERE mime_type IS NOT NULL GROUP BY 1),
      p AS (SELECT message_id, string_agg(DISTINCT source_record_key, ',' ORDER BY source_record_key) AS source_record_keys, string_agg(DISTINCT {_RUN}, ',' ORDER BY {_RUN}) AS source_snapshot_keys, string_agg(DISTINCT parser_version, ',' ORDER BY parser_version) AS parser_versions FROM message_source s JOIN import_run i ON i.import_run_id = s.import_run_id GROUP BY 1)
      SELECT m.message_id, reply_to, mime_types, source_record_keys, source_snapshot_keys, parser_versions FROM message m LEFT JOIN r USING (message_id) LEFT JOIN k USING (message_id) LEFT JOIN p USING (message_id)""",
    "vertical_reconciliation": f"""{_WITH}, s0 AS (SELECT 'k' || event_id AS k, CASE WHEN event_id % 10 = 0 THEN 1 WHEN event_id % 601 = 0 THEN 2 ELSE 0 END AS na, CASE WHEN event_id % 607 = 0 THEN 3 ELSE 1 END AS nc FROM events WHERE event_id % 527 <> 0), sg AS (SELECT * FROM s0 UNION ALL SELECT * FROM s0 WHERE k = 'k7'),
      j AS (SELECT sg.*, (SELECT count(*) FROM occurrence o WHERE o.message_id = m.message_id) AS o, (SELECT count(*) FROM membership b WHERE b.message_id = m.message_id) AS m FROM sg JOIN message_source m ON m.source_record_key = sg.k) """
    + _issues({
        "STAGED_RECORD_MISSING": "SELECT count(*) FROM (SELECT k FROM sg EXCEPT ALL SELECT source_record_key FROM message_source)", "UNSTAGED_RECORD_PRESENT": "SELECT count(*) FROM (SELECT source_record_key FROM message_source EXCEPT ALL SELECT k FROM sg)",
        "SOURCE_WITHOUT_MESSAGE": "SELECT count(*) FROM message_source WHERE message_id NOT IN (SELECT message_id FROM message)", "ATTACHMENTS_LOST": "SELECT count(*) FROM j WHERE na > o", "MEMBERSHIPS_LOST": "SELECT count(*) FROM j WHERE nc > m",
    }),
    "evidence_drift": f"WITH {ad.SQL_SPARSE} SELECT CASE WHEN message_id % 31 = 0 THEN -message_id ELSE message_id END AS message_id, CASE WHEN message_id % 31 = 0 AND message_id <> 0 THEN 'FAIL' WHEN message_id % 37 = 0 THEN 'UNVERIFIED' WHEN message_id % 41 = 0 OR (message_id % 43 = 0 AND timestamp_us IS NOT NULL) THEN 'STALE' ELSE 'PASS' END AS status FROM msg",
    "resolution_audit": "WITH u AS (SELECT DISTINCT user_id AS p FROM events), w AS (SELECT p, CASE WHEN p % 50 = 0 THEN (SELECT min(p) FROM u WHERE p % 50 = 0) ELSE p END AS r FROM u) " + _issues({"RESOLUTION_MISSING": "SELECT count(*) FROM w WHERE p % 7 = 0", "RESOLUTION_UNKNOWN_PARTICIPANT": "SELECT 1", "RESOLUTION_DIFFERS": "SELECT count(*) FROM w WHERE p % 7 <> 0 AND p % 11 = 0 AND p + 1 <> r"}),
    "context_warnings": f"{_WITH} " + _issues({"UNKNOWN_TIMESTAMPS": "SELECT count(*) FROM events WHERE event_id % 23 = 0", "PROVENANCE_MISSING": "SELECT count(*) FROM events WHERE event_id NOT IN (SELECT message_id FROM message_source)"}),
    "resolved_latest": "SELECT 2::BIGINT AS run_id, event_id AS membership_id, user_id AS sender_id, CASE WHEN event_id % 5 <> 0 THEN user_id + 1 END AS resolved_sender_id FROM events WHERE event_id % 3 = 1",
    "labelled_responses": "WITH p AS (SELECT DISTINCT user_id AS i, 'User ' || (user_id % 40) AS name FROM events WHERE user_id % 9 <> 0) SELECT event_id, user_id AS responder_id, user_id + 3 AS from_id, a.name AS responder_id_name, b.name AS from_id_name FROM events LEFT JOIN p a ON a.i = user_id LEFT JOIN p b ON b.i = user_id + 3",
    "exact_targets": "WITH u AS (SELECT DISTINCT user_id AS p FROM events), n AS (SELECT 'User ' || (p % 40) AS label, count(DISTINCT p // 2) AS found, min(p // 2) AS c FROM u GROUP BY 1) SELECT ' ID ' || p AS label, 1::BIGINT AS found, p // 2 AS conversation_id FROM u UNION ALL SELECT label, found, CASE WHEN found = 1 THEN c END FROM n",
    "last_messages": f"WITH {ad.SQL_SPARSE} SELECT conversation_id, membership_id, timestamp_us FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY timestamp_us DESC NULLS LAST, membership_id DESC) AS n FROM msg) WHERE n <= 5",
    "store_fingerprint": f"{_WITH} " + " UNION ALL ".join(_fingerprint(n) for n in TABLES),
}
