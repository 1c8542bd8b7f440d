"""Queries of packets, gates and moves from older schemas, over tables with planted faults, and their SQL.

The inputs are SQL that Spark and DuckDB both run; what the operators do with them is written again for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import canonical as ca
from ..operators import gates as gt
from ..operators import packets as pk
from ..operators import structure as st
from . import adapters as ad
from .store import TABLES, store

_C = "CAST(floor(user_id / 2) AS BIGINT)"
_V = "CAST({} AS VARCHAR(20))"
INPUTS = {
    "selected": f"""SELECT {_C} AS packet_id, event_id AS message_id FROM events WHERE event_type = 'error' UNION ALL SELECT {_C}, event_id FROM events WHERE event_type = 'error' AND event_id % 30 = 0
      UNION ALL SELECT {_C} + 1, event_id FROM events WHERE event_id % 70 = 0 UNION ALL SELECT {_C}, -event_id FROM events WHERE event_id % 500 = 499""",
    "candidate": f"""SELECT event_id AS candidate_id, event_id % 7 AS analytics_run_id, {_C} AS conversation_id, CASE event_id % 6 WHEN 0 THEN ' Conflict' WHEN 1 THEN 'change_point' WHEN 2 THEN 'dyadic_regime' WHEN 3 THEN 'engagement_signal' WHEN 4 THEN 'lexical_topic' END AS candidate_type FROM events""",
    "analytics_run": "SELECT CAST(r AS BIGINT) AS analytics_run_id, 'v5' AS analytics_version, CAST(r + 100 AS BIGINT) AS processing_run_id, CASE WHEN r = 3 THEN 'failed' WHEN r <> 4 THEN 'completed' END AS status FROM (SELECT DISTINCT event_id % 6 AS r FROM events) AS q",
    "state": f"SELECT DISTINCT event_id % 7 AS analytics_run_id, {_C} AS conversation_id, concat('f', {_V.format(_C)}) AS source_fingerprint, 's' AS analysis_signature FROM events WHERE {_C} % 11 <> 0",
    "labelled": f"""SELECT event_id, CASE WHEN event_id % 13 = 0 THEN 'no json' ELSE concat('{{"guid":"', CASE WHEN event_id % 3 <> 0 THEN concat('g', {_V.format('event_id')}) ELSE '' END, '","metadata":{{"guid":"inner","display_name":"', event_type, '","metadata":{{"room_name":"r', {_V.format('user_id')}, '","group_id":null}}}}}}') END AS metadata FROM events""",
    "titled": f"SELECT DISTINCT {_C} AS conversation_id, CASE WHEN {_C} % 2 = 0 THEN concat('T', {_V.format(_C)}) END AS title, CASE WHEN {_C} % 3 = 0 THEN 'key' END AS canonical_key FROM events",
    "bundle": f"""SELECT u AS bundle_id, CASE WHEN u % 19 = 0 THEN NULL WHEN u % 23 = 0 THEN '[1' ELSE concat('{{"source":{{"type":"csv","sha256":"s', {_V.format('u')}, '"}},"counts":{{"unsupported":', {_V.format('u % 2')}, ',"duplicates":0,"reconciliation_errors":', CASE WHEN u % 29 = 0 THEN '2' ELSE '0' END, '}}}}') END AS manifest,
      CASE WHEN u % 17 = 0 THEN NULL WHEN u % 31 = 0 THEN 'x' ELSE concat('{{"reconciliation_version":"', CASE WHEN u % 5 = 0 THEN '2' ELSE '1' END, '","status":"', CASE WHEN u % 7 = 0 THEN 'failed' ELSE 'ok' END, '","ok":true,"source":{{"type":"', CASE WHEN u % 11 = 0 THEN 'json' ELSE 'csv' END, '","sha256":"s', {_V.format('u')}, '","actual_sha256":"', CASE WHEN u % 13 = 0 THEN 'other' ELSE concat('s', {_V.format('u')}) END,
      '"}},"bundle":{{"messages_jsonl_records":', {_V.format('n + CASE WHEN u % 4 = 0 THEN 1 ELSE 0 END')}, ',"errors_jsonl_records":0}},"checks":{{"a":true,"b":', CASE WHEN u % 9 = 0 THEN 'false' ELSE 'true' END, '}},"failed_checks":[', CASE WHEN u % 10 = 0 THEN '"a"' ELSE '' END, '],"parse_failures":[],"unsupported_records":[', CASE WHEN u % 2 = 1 AND u % 3 <> 0 THEN '"r"' ELSE '' END, '],"duplicate_records":[]}}') END AS report
      FROM (SELECT user_id AS u, count(*) AS n FROM events GROUP BY user_id) AS q""",
    "published": f"""SELECT conversation_id, CASE WHEN conversation_id % 5 = 0 THEN 1 ELSE 0 END AS membership_count_delta, CASE WHEN conversation_id % 7 <> 0 THEN 0 END AS invalid_response_session_count, CASE WHEN conversation_id % 11 = 0 THEN 0 ELSE 1 END AS uses_latest_processing_run, CASE WHEN conversation_id % 13 = 0 THEN 0 ELSE 1 END AS reconciliation_ok,
      n AS a4_source_membership_count, CASE WHEN conversation_id % 3 = 0 THEN n + 1 ELSE n END AS a3_processed_membership_count, CASE WHEN conversation_id % 17 <> 0 THEN n END AS sender_accounted_membership_count FROM (SELECT {_C} AS conversation_id, count(*) AS n FROM events GROUP BY {_C}) AS q WHERE conversation_id % 19 <> 0""",
    "legacy": f"""SELECT conversation_id AS conversation_source_id, conversation_id, CAST(conversation_id % 4 AS BIGINT) AS import_run_id, CASE WHEN conversation_id % 2 = 0 THEN 'json' ELSE 'csv' END AS source_type, concat('c', {_V.format('conversation_id')}) AS source_conversation_id FROM (SELECT DISTINCT {_C} AS conversation_id FROM events WHERE {_C} % 3 = 0) AS q""",
    "finding": f"SELECT event_id AS finding_id, user_id, CASE WHEN event_id % 9 <> 0 THEN CAST(floor(value) AS BIGINT) END AS start_us, CAST(floor(value) AS BIGINT) + event_id % 3 AS end_us, event_type AS candidate_type, event_id AS candidate_id FROM events",
}


def inputs(spark, sf_dir: str, *names: str) -> list[DataFrame]:
    """Each input over the events; these are a view, since the JSON in the SQL has braces of its own."""
    ad.table(spark, sf_dir, "events").createOrReplaceTempView("gate_events")
    return [spark.sql(INPUTS[n].replace("FROM events", "FROM gate_events")) for n in names]


def packet_messages(spark, sf_dir: str) -> DataFrame:
    rows = pk.packet_rows(ad.sparse(spark, sf_dir), inputs(spark, sf_dir, "selected")[0], 2, 1)
    return rows.select("packet_id", "membership_id", "timestamp_us", "selected")


def packet_selection(spark, sf_dir: str) -> DataFrame:
    return pk.selection_faults(ad.sparse(spark, sf_dir), inputs(spark, sf_dir, "selected")[0], 2, 1)


def _packets(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All messages of a conversation as a packet, errors selected; faults in what is told and in the rows."""
    i, p = F.col("message_id"), F.col("packet_id")
    keys = lambda n, c: F.when(i % n != 0, F.array(F.concat(F.lit(c), i.cast("string"))))
    m = ad.sparse(spark, sf_dir)
    provenance = m.where("message_id % 53 <> 0").select(i, keys(57, "k").alias("source_record_keys"), keys(58, "s").alias("source_snapshot_keys"), keys(62, "p").alias("parser_versions"))
    rows = pk.with_provenance(m.select(F.col("conversation_id").alias("packet_id"), "conversation_id", i, "membership_id", "timestamp_us", "text", F.col("text").startswith("error").alias("selected")), provenance)
    headers = pk.packet_headers(rows).withColumns({
        "message_count": F.col("message_count") + F.when(p % 5 == 0, 1).otherwise(0), "source_provenance_required": p % 7 != 0,
        "selected_message_ids": F.when(p % 9 == 0, F.concat("selected_message_ids", F.array(F.lit(-1).cast("bigint"), F.lit(-1).cast("bigint")))).otherwise(F.col("selected_message_ids")),
    })
    return headers, rows.withColumns({"membership_id": F.when(i % 61 == 0, F.lit(-1).cast("bigint")).when(i % 59 != 0, F.col("membership_id")), "conversation_id": F.when(i % 67 == 0, F.col("conversation_id") + 1).otherwise(F.col("conversation_id"))})


def packet_contract(spark, sf_dir: str) -> DataFrame:
    return pk.packet_faults(*_packets(spark, sf_dir))


def packet_records(spark, sf_dir: str) -> DataFrame:
    headers, rows = _packets(spark, sf_dir)
    faults = pk.packet_faults(headers, rows).where("code = 'A6_PACKET_MULTIPLE_CONVERSATIONS' OR code = 'A6_PACKET_MESSAGE_COUNT_MISMATCH'")
    return pk.packet_records(rows, faults).select("packet_id", "message_id", "membership_key", "position")


def packet_hashes(spark, sf_dir: str) -> DataFrame:
    m = ad.sparse(spark, sf_dir)
    ids = m.groupBy("conversation_id").agg(F.sort_array(F.collect_list(F.when(F.col("timestamp_us").isNull(), F.col("message_id")))).alias("i"))
    rows = m.select("conversation_id", "message_id", pk.context_hash(["text", "message_id", "timestamp_us"], "conflict", "local", "p", "m", "1").alias("context_hash"))
    return rows.join(ids.select("conversation_id", pk.ids_hash(F.col("i")).alias("omitted_hash")), "conversation_id").select("message_id", "context_hash", "omitted_hash")


def candidate_provenance(spark, sf_dir: str) -> DataFrame:
    rows = pk.candidate_provenance(*inputs(spark, sf_dir, "candidate", "analytics_run", "state"))
    return rows.select("candidate_id", "processing_run_id", "source_fingerprint", "provenance_status", "candidate_semantics")


def source_labels(spark, sf_dir: str) -> DataFrame:
    rows = inputs(spark, sf_dir, "labelled")[0]
    return rows.select("event_id", pk.source_labels(F.col("metadata")).alias("l")).select("event_id", "l.guid", "l.display_name", "l.room_name", "l.group_id")


def contact_labels(spark, sf_dir: str) -> DataFrame:
    return pk.contact_labels(inputs(spark, sf_dir, "titled")[0])


def conversation_selection(spark, sf_dir: str) -> DataFrame:
    wanted = inputs(spark, sf_dir, "titled")[0].where("title IS NOT NULL")
    rows = pk.of_conversations(ad.sparse(spark, sf_dir), wanted)
    return pk.between(rows, 1_704_500_000_000_000, 1_705_500_000_000_000).select("membership_id", "timestamp_us")


def reading_ranks(spark, sf_dir: str) -> DataFrame:
    f = inputs(spark, sf_dir, "finding")[0]
    rank = lambda order: F.row_number().over(Window.partitionBy("user_id").orderBy(*order))
    return f.select("finding_id", rank(pk.finding_order()).alias("finding_rank"), rank(pk.candidate_order()).alias("candidate_rank"))


def bundle_gate(spark, sf_dir: str) -> DataFrame:
    bundles = inputs(spark, sf_dir, "bundle")[0]
    rows = ad.table(spark, sf_dir, "events").select(F.col("user_id").alias("bundle_id"))
    return gt.bundle_faults(bundles, rows, rows.where("bundle_id % 37 = 0"))


def staging_contract(spark, sf_dir: str) -> DataFrame:
    """A bundle for each user, a line for each event; lines, records and manifests with faults."""
    i, sha = F.col("event_id"), F.lit("a" * 64)
    text = lambda c: c.cast("string")
    key = F.when(i % 53 == 0, F.lit("short")).when(i % 59 == 0, F.lit("b" * 64)).otherwise(ca.stable_key(sha, F.lit(""), text(i), text(F.col("user_id"))))
    fields = {
        "source_record_key": key, "contract_version": F.when(i % 61 != 0, "1"), "record_type": F.when(i % 67 != 0, "message").otherwise("note"), "source_type": F.when(i % 71 != 0, "csv").otherwise("json"), "source_sha256": sha, "source_message_id": text(i), "conversation_source_id": text(F.col("user_id")),
        "timestamp_utc": F.when(i % 73 == 0, "soon").when(i % 79 != 0, "2024-01-01T00:00:00Z"), "timestamp_raw": F.lit("raw"), "attachments": F.when(i % 83 == 0, F.array(F.struct(F.lit("x").alias("sha256")))),
    }
    e = ad.table(spark, sf_dir, "events").withColumn("_object", (i % 41 != 0) & (i % 43 != 0) & (i % 47 != 0))
    lines = e.select(F.col("user_id").alias("bundle_id"), F.when(i % 41 == 0, " ").when(i % 43 == 0, "{x").when(i % 47 == 0, "[]").otherwise(F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]))).alias("value"))
    u = F.col("bundle_id")
    counts = F.struct((F.col("n") + F.when(u % 4 == 0, 1).otherwise(0)).alias("messages_seen"), F.col("n").alias("messages_emitted"), F.col("f").alias("attachments_seen"), F.when(u % 6 == 0, 1).otherwise(0).alias("errors"))
    told = F.to_json(F.struct(F.lit("1").alias("contract_version"), F.struct(F.lit("csv").alias("type"), sha.alias("sha256")).alias("source"), F.struct(F.lit("p").alias("name"), F.lit("1").alias("version")).alias("parser"), F.struct(F.lit("m").alias("messages")).alias("outputs"), counts.alias("counts"), F.struct(F.when(u % 9 == 0, "7").otherwise("1").alias("version")).alias("source_record_key")))
    per = e.groupBy(F.col("user_id").alias("bundle_id")).agg(F.count_if("_object").alias("n"), F.count_if(F.col("_object") & (i % 83 == 0)).alias("f"))
    return gt.staging_faults(lines, per.select("bundle_id", F.when(u % 19 != 0, told).alias("manifest")))


def source_accounts(spark, sf_dir: str) -> DataFrame:
    e = ad.table(spark, sf_dir, "events").select(F.col("event_id").alias("source_key"))
    return gt.source_accounts(e.where("source_key % 97 <> 0"), emitted=e.where("source_key % 5 <> 0"), errors=e.where("source_key % 5 = 0 AND source_key % 3 <> 0"), unsupported=e.where("source_key % 101 = 0"), duplicates=e.where("source_key % 15 = 0 AND source_key % 2 = 0"))


def reader_gate(spark, sf_dir: str) -> DataFrame:
    published, wanted = inputs(spark, sf_dir, "published", "titled")
    return gt.reader_faults(published.union(published.where("conversation_id = 1")), wanted)


def analytics_oracle(spark, sf_dir: str) -> DataFrame:
    """Turns and messages of the operator for each participant, some altered, against the places where another sender or session stood before."""
    m = st.structured(ad.sparse(spark, sf_dir))
    w = Window.partitionBy("conversation_id").orderBy("sequence_number")
    new = (F.row_number().over(w) == 1) | ~F.col("sender_id").eqNullSafe(F.lag("sender_id").over(w)) | (F.lag("session_no").over(w) != F.col("session_no"))
    again = m.select(F.col("sender_id").alias("participant_id"), new.cast("int").alias("t")).groupBy("participant_id").agg(F.sum("t").alias("turn_count"), F.count("*").alias("message_count"))
    p = F.col("participant_id")
    told = st.turns(st.processed(ad.sparse(spark, sf_dir), ad.EVENTS)).groupBy("participant_id").agg(F.count("*").cast("double").alias("turn_count"), F.sum("message_count").alias("message_count"))
    told = told.where("participant_id IS NULL OR participant_id % 7 <> 0").withColumns({"turn_count": F.col("turn_count") + F.when(p % 3 == 0, 1e-10).otherwise(0.0), "message_count": F.col("message_count") + F.when(p % 10 == 0, 1).otherwise(0)})
    return gt.metrics_differ(told, again, ["participant_id"], ["turn_count", "message_count"])


def schema_actions(spark, sf_dir: str) -> DataFrame:
    have = ad.table(spark, sf_dir, "nation").select(F.col("n_name").alias("object"), F.col("n_regionkey").alias("version")).where("version <> 2")
    wanted = ad.table(spark, sf_dir, "nation").select(F.col("n_name").alias("object"), F.lit(3).alias("version")).where("object <> 'FRANCE' AND object <> 'ALGERIA'")
    return gt.schema_actions(have, wanted)


def backfilled_sources(spark, sf_dir: str) -> DataFrame:
    s = store(spark, sf_dir)
    return gt.backfill_conversation_sources(inputs(spark, sf_dir, "legacy")[0], s["import_run"], s["message_source"], s["message"])


def backfilled_links(spark, sf_dir: str) -> DataFrame:
    s = store(spark, sf_dir)
    return gt.backfill_links(s["message_source"], s["import_run"], backfilled_sources(spark, sf_dir), s["membership"])


def backfilled_sha(spark, sf_dir: str) -> DataFrame:
    meta = F.when(F.col("event_id") % 4 == 0, F.lit("{broken")).otherwise(F.concat(F.lit('{"source":{"sha256":"s'), F.col("event_id").cast("string"), F.lit('"}}')))
    runs = ad.table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, "own").alias("source_sha256"), meta.alias("metadata_json"))
    return gt.backfill_sha(runs).select("event_id", "source_sha256")


def gate_report(spark, sf_dir: str) -> DataFrame:
    return gt.report(source_accounts(spark, sf_dir))


def _with(*names: str, first: str = "") -> str:
    return "WITH " + ", ".join(([first] if first else []) + [f"{n} AS ({INPUTS.get(n) or TABLES[n]})" for n in names])


def _stack(keys: str, cases: dict[str, str], source: str, severity: str = "") -> str:
    """A row (keys, code, n) for each case above 0."""
    cells = ", ".join(f"struct_pack(code := '{code}', n := ({sql})::BIGINT)" for code, sql in cases.items())
    return f"SELECT {keys}, c.code AS code, c.n AS n{severity} FROM (SELECT {keys}, unnest([{cells}]) AS c FROM {source}) WHERE c.n > 0"


_PLACED = f"{ad.SQL_SPARSE}, placed AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY timestamp_us NULLS LAST, membership_id) AS place FROM msg)"
_ROWS = "hit AS (SELECT DISTINCT packet_id, conversation_id, place FROM selected JOIN placed USING (message_id)), pr AS (SELECT packet_id, p.conversation_id, membership_id, timestamp_us, bool_or(p.place = hit.place) AS selected FROM hit JOIN placed p ON p.conversation_id = hit.conversation_id AND p.place BETWEEN hit.place - 2 AND hit.place + 1 GROUP BY ALL)"
_CONTRACT = f"""WITH {ad.SQL_SPARSE}, r AS (SELECT conversation_id AS packet_id, message_id, timestamp_us, text LIKE 'error%' AS sel, CASE WHEN message_id % 61 = 0 THEN -1 WHEN message_id % 59 <> 0 THEN membership_id END AS mb, conversation_id + CASE WHEN message_id % 67 = 0 THEN 1 ELSE 0 END AS cv,
  message_id % 53 = 0 OR message_id % 57 = 0 OR message_id % 58 = 0 AS lost, message_id % 53 = 0 OR message_id % 57 = 0 OR message_id % 58 = 0 OR message_id % 62 = 0 AS bare FROM msg),
h AS (SELECT packet_id, count(*) AS n, count(*) + CASE WHEN packet_id % 5 = 0 THEN 1 ELSE 0 END AS told, count(*) FILTER (WHERE sel) AS s, packet_id % 7 <> 0 AS req, packet_id % 9 = 0 AS more, count(*) FILTER (WHERE mb IS NULL) AS nomb, count(mb) - count(DISTINCT mb) AS twice, count(DISTINCT cv) AS cvs,
  count(*) FILTER (WHERE timestamp_us IS NULL) AS nt, count(*) FILTER (WHERE lost) AS lost, count(*) FILTER (WHERE bare) AS bare FROM r GROUP BY 1)"""
_CONTRACT_CASES = {
    "A6_PACKET_SELECTED_IDS_DUPLICATE": "CASE WHEN more THEN 1 ELSE 0 END", "A6_PACKET_MEMBERSHIP_ID_MISSING": "nomb", "A6_PACKET_MEMBERSHIP_DUPLICATE": "twice", "A6_PACKET_MULTIPLE_CONVERSATIONS": "CASE WHEN cvs > 1 THEN cvs ELSE 0 END",
    "A6_PACKET_SELECTED_FLAG_MISMATCH": "CASE WHEN more THEN 1 ELSE 0 END", "A6_PACKET_SELECTION_EMPTY": "CASE WHEN s = 0 AND NOT more THEN 1 ELSE 0 END", "A6_PACKET_UNKNOWN_TIMESTAMP": "nt", "A6_PACKET_SOURCE_PROVENANCE_MISSING": "CASE WHEN req THEN bare ELSE 0 END",
    "A6_PACKET_MESSAGE_PROVENANCE_STATUS_INVALID": "CASE WHEN req THEN lost ELSE 0 END", "A6_PACKET_MESSAGE_COUNT_MISMATCH": "CASE WHEN told <> n THEN 1 ELSE 0 END", "A6_PACKET_SELECTED_COUNT_MISMATCH": "CASE WHEN more THEN 1 ELSE 0 END",
    "A6_PACKET_PROVENANCE_MISSING_LIST_NONEMPTY": "CASE WHEN req THEN lost ELSE 0 END", "A6_PACKET_SOURCE_PROVENANCE_STATUS_INVALID": "CASE WHEN req AND lost > 0 THEN 1 ELSE 0 END", "A6_PACKET_SOURCE_PROVENANCE_UNVERIFIED": "CASE WHEN NOT req THEN 1 ELSE 0 END",
}
_BUNDLE_CASES = {
    "RECONCILIATION_MANIFEST_MISSING": "u % 19 = 0", "RECONCILIATION_MANIFEST_INVALID": "u % 19 <> 0 AND u % 23 = 0", "RECONCILIATION_MISSING": "u % 19 <> 0 AND u % 23 <> 0 AND u % 17 = 0", "RECONCILIATION_INVALID": "u % 19 <> 0 AND u % 23 <> 0 AND u % 17 <> 0 AND u % 31 = 0",
    **{code: f"u % 19 <> 0 AND u % 23 <> 0 AND u % 17 <> 0 AND u % 31 <> 0 AND {sql}" for code, sql in {
        "RECONCILIATION_VERSION_UNSUPPORTED": "u % 5 = 0", "RECONCILIATION_FAILED": "u % 7 = 0", "RECONCILIATION_FAILED_CHECKS": "u % 10 = 0", "RECONCILIATION_INTERNAL_CHECK_FAILED": "u % 9 = 0", "RECONCILIATION_SOURCE_TYPE_MISMATCH": "u % 11 = 0", "RECONCILIATION_SOURCE_SHA_MISMATCH": "u % 13 = 0",
        "RECONCILIATION_MESSAGE_COUNT_MISMATCH": "u % 4 = 0", "RECONCILIATION_ERROR_COUNT_MISMATCH": "u % 37 = 0", "RECONCILIATION_UNSUPPORTED_COUNT_MISMATCH": "u % 2 = 1 AND u % 3 = 0", "A1_RECONCILIATION_ERRORS": "u % 29 = 0",
    }.items()},
}
_ACCOUNTS = """WITH k AS (SELECT event_id AS k FROM events), told AS (SELECT k, CASE WHEN k % 5 <> 0 THEN 1 ELSE 0 END + CASE WHEN k % 5 = 0 AND k % 3 <> 0 THEN 1 ELSE 0 END + CASE WHEN k % 101 = 0 THEN 1 ELSE 0 END + CASE WHEN k % 15 = 0 AND k % 2 = 0 THEN 1 ELSE 0 END AS t, CASE WHEN k % 97 <> 0 THEN 1 ELSE 0 END AS h FROM k),
a AS (SELECT count(*) FILTER (WHERE t < h) AS u, count(*) FILTER (WHERE h > 0 AND t > h) AS x, count(*) FILTER (WHERE h = 0 AND t > 0) AS w FROM told), q AS (SELECT unnest([struct_pack(code := 'SOURCE_RECORD_UNACCOUNTED', n := u), struct_pack(code := 'SOURCE_RECORD_ACCOUNTED_TWICE', n := x), struct_pack(code := 'OUTCOME_WITHOUT_SOURCE', n := w)]) AS c FROM a),
s AS (SELECT c.code AS code, c.n AS n, CASE WHEN c.n > 0 THEN 'ERROR' ELSE 'OK' END AS severity FROM q)"""
_RUN_KEY = "coalesce(r.source_sha256, 'fingerprint:' || r.source_fingerprint)"
_SOURCES = f"""old AS (SELECT conversation_source_id, conversation_id, l.import_run_id, l.source_type, coalesce({_RUN_KEY}, 'legacy-conversation-source:' || conversation_source_id) AS source_snapshot_key, r.source_sha256, source_conversation_id, NULL::VARCHAR AS recovered_from FROM legacy l LEFT JOIN import_run r USING (import_run_id)),
found AS (SELECT s.source_type, {_RUN_KEY} AS source_snapshot_key, s.source_conversation_id, m.conversation_id, s.import_run_id, r.source_sha256 FROM message_source s JOIN message m ON m.message_id = s.message_id JOIN import_run r ON r.import_run_id = s.import_run_id WHERE s.source_conversation_id <> ''),
one AS (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY source_type, source_snapshot_key, source_conversation_id ORDER BY conversation_id, import_run_id) = 1),
cs AS (SELECT * FROM old UNION ALL SELECT NULL, conversation_id, import_run_id, source_type, source_snapshot_key, source_sha256, source_conversation_id, 'message_source' FROM one WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.source_type = one.source_type AND old.source_snapshot_key = one.source_snapshot_key AND old.source_conversation_id = one.source_conversation_id))"""
_JSON = "to_json(struct_pack(analysis_type := 'conflict', context := struct_pack(message_id := message_id, text := text, timestamp_us := timestamp_us), mode := 'local', model := 'm', prompt_version := '1', provider := 'p'))::VARCHAR"

_LINE_CASES = {
    "EMPTY_LINE": "i % 41 = 0", "MESSAGE_JSON_INVALID": "i % 41 <> 0 AND i % 43 = 0", "MESSAGE_NOT_OBJECT": "i % 41 <> 0 AND i % 43 <> 0 AND i % 47 = 0",
    **{code: f"told AND {sql}" for code, sql in {
        "SOURCE_RECORD_KEY_INVALID": "i % 53 = 0", "SOURCE_RECORD_KEY_CONTRACT_UNKNOWN": "b % 9 = 0", "SOURCE_RECORD_KEY_MISMATCH": "b % 9 <> 0 AND (i % 53 = 0 OR i % 59 = 0)", "CONTRACT_VERSION_MISMATCH": "i % 61 = 0", "RECORD_TYPE_INVALID": "i % 67 = 0", "SOURCE_TYPE_MISMATCH": "i % 71 = 0",
        "TIMESTAMP_INVALID": "i % 73 = 0", "TIMESTAMP_UNNORMALIZED": "i % 73 <> 0 AND i % 79 = 0", "ATTACHMENT_SOURCE_ID_MISSING": "i % 83 = 0", "ATTACHMENT_SHA256_INVALID": "i % 83 = 0",
    }.items()},
}
_STAGED = f"""WITH l AS (SELECT user_id AS b, event_id AS i, user_id % 19 <> 0 AND event_id % 41 <> 0 AND event_id % 43 <> 0 AND event_id % 47 <> 0 AS told FROM events),
h AS (SELECT b, {', '.join(f"count(*) FILTER (WHERE {sql}) AS {code}" for code, sql in _LINE_CASES.items())}, greatest(count(*) FILTER (WHERE told AND i % 53 <> 0 AND i % 59 = 0) - 1, 0) AS SOURCE_RECORD_KEY_DUPLICATE, CASE WHEN b % 19 = 0 THEN 1 ELSE 0 END AS MANIFEST_MISSING,
  CASE WHEN b % 19 <> 0 AND b % 4 = 0 THEN 1 ELSE 0 END AS MESSAGES_SEEN_MISMATCH, CASE WHEN b % 19 <> 0 AND b % 6 = 0 THEN 1 ELSE 0 END AS A1_EXTRACTION_ERRORS FROM l GROUP BY b), g AS (SELECT b AS bundle_id, * EXCLUDE (b) FROM h)"""
_STAGED_CODES = [*_LINE_CASES, "SOURCE_RECORD_KEY_DUPLICATE", "MANIFEST_MISSING", "MESSAGES_SEEN_MISMATCH", "A1_EXTRACTION_ERRORS"]

QUERIES = {f.__name__: f for f in (
    packet_messages, packet_selection, packet_contract, packet_records, packet_hashes, candidate_provenance, source_labels, contact_labels, conversation_selection, reading_ranks, bundle_gate, staging_contract, source_accounts, reader_gate, analytics_oracle, schema_actions, backfilled_sources, backfilled_links, backfilled_sha,
    gate_report,
)}
ORACLES = {
    "packet_messages": f"{_with('selected', first=_PLACED)}, {_ROWS} SELECT packet_id, membership_id, timestamp_us, selected FROM pr",
    "packet_selection": f"""{_with('selected', first=_PLACED)}, {_ROWS} SELECT packet_id, 'SELECTED_ID_DUPLICATE' AS code, count(*) AS n FROM (SELECT packet_id, message_id FROM selected GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1
      UNION ALL SELECT packet_id, 'SELECTED_ID_MISSING', count(*) FROM (SELECT DISTINCT * FROM selected) WHERE message_id NOT IN (SELECT message_id FROM msg) GROUP BY 1 UNION ALL SELECT packet_id, 'SEVERAL_CONVERSATIONS', count(DISTINCT conversation_id) FROM pr WHERE selected GROUP BY 1 HAVING count(DISTINCT conversation_id) > 1
      UNION ALL SELECT packet_id, CASE WHEN selected THEN 'SELECTED_TIME_UNKNOWN' ELSE 'CONTEXT_TIME_UNKNOWN' END, count(*) FROM pr WHERE timestamp_us IS NULL GROUP BY packet_id, selected""",
    "packet_contract": _CONTRACT + _stack("packet_id", _CONTRACT_CASES, "h", ", CASE WHEN c.code LIKE '%UNVERIFIED' THEN 'WARNING' ELSE 'ERROR' END AS severity"),
    "packet_records": f"{_CONTRACT} SELECT r.packet_id, message_id, coalesce(mb::VARCHAR, 'compat:' || cv || ':' || message_id) AS membership_key, row_number() OVER (PARTITION BY r.packet_id ORDER BY timestamp_us NULLS FIRST, message_id) AS position FROM r JOIN h USING (packet_id) WHERE cvs = 1 AND told = n",
    "packet_hashes": f"WITH {ad.SQL_SPARSE}, o AS (SELECT conversation_id, sha256(to_json(list(message_id::VARCHAR ORDER BY message_id))::VARCHAR) AS omitted_hash FROM msg WHERE timestamp_us IS NULL GROUP BY 1) SELECT message_id, sha256({_JSON}) AS context_hash, omitted_hash FROM msg LEFT JOIN o USING (conversation_id)",
    "candidate_provenance": f"""{_with('candidate', 'analytics_run', 'state')} SELECT candidate_id, processing_run_id, source_fingerprint, CASE WHEN r.analytics_run_id IS NULL THEN 'run_missing' WHEN status IS DISTINCT FROM 'completed' THEN 'run_not_completed' WHEN s.analysis_signature IS NULL THEN 'state_missing' ELSE 'complete' END AS provenance_status,
      CASE lower(trim(candidate_type)) WHEN 'conflict' THEN 'pattern_candidate' WHEN 'dyadic_regime' THEN 'pattern_candidate' WHEN 'engagement_signal' THEN 'heuristic_signal' WHEN 'change_point' THEN 'metric_pattern' WHEN 'lexical_topic' THEN 'lexical_evidence' ELSE 'candidate' END AS candidate_semantics
      FROM candidate c LEFT JOIN analytics_run r ON r.analytics_run_id = c.analytics_run_id LEFT JOIN state s ON s.analytics_run_id = c.analytics_run_id AND s.conversation_id = c.conversation_id""",
    "source_labels": "SELECT event_id, CASE WHEN event_id % 13 <> 0 THEN CASE WHEN event_id % 3 <> 0 THEN 'g' || event_id ELSE 'inner' END END AS guid, CASE WHEN event_id % 13 <> 0 THEN event_type END AS display_name, CASE WHEN event_id % 13 <> 0 THEN 'r' || user_id END AS room_name, NULL::VARCHAR AS group_id FROM events",
    "contact_labels": "SELECT DISTINCT user_id // 2 AS conversation_id, CASE WHEN (user_id // 2) % 2 = 0 THEN 'T' || (user_id // 2) WHEN (user_id // 2) % 3 = 0 THEN 'key' ELSE (user_id // 2)::VARCHAR END AS contact FROM events",
    "conversation_selection": f"WITH {ad.SQL_SPARSE} SELECT membership_id, timestamp_us FROM msg WHERE conversation_id % 2 = 0 AND timestamp_us BETWEEN 1704500000000000 AND 1705500000000000",
    "reading_ranks": f"{_with('finding')} SELECT finding_id, row_number() OVER (PARTITION BY user_id ORDER BY start_us DESC NULLS LAST, finding_id) AS finding_rank, row_number() OVER (PARTITION BY user_id ORDER BY start_us NULLS FIRST, end_us NULLS FIRST, candidate_type, candidate_id) AS candidate_rank FROM finding",
    "bundle_gate": f"WITH b AS (SELECT DISTINCT user_id AS u FROM events) " + " UNION ALL ".join(f"SELECT u AS bundle_id, '{code}' AS code FROM b WHERE {sql}" for code, sql in _BUNDLE_CASES.items()),
    "staging_contract": f"{_STAGED} " + _stack("bundle_id", {code: code for code in _STAGED_CODES}, "g", ", CASE WHEN c.code IN ('EMPTY_LINE', 'TIMESTAMP_UNNORMALIZED', 'ATTACHMENT_SOURCE_ID_MISSING') THEN 'WARNING' ELSE 'ERROR' END AS severity"),
    "source_accounts": f"{_ACCOUNTS} SELECT * FROM s",
    "reader_gate": f"""{_with('published', 'titled')}, p AS (SELECT * FROM published UNION ALL SELECT * FROM published WHERE conversation_id = 1), w AS (SELECT t.conversation_id, (SELECT min(reconciliation_ok) FROM p WHERE p.conversation_id = t.conversation_id) AS ok FROM titled t)
      SELECT conversation_id, 'MEMBERSHIP_COUNT_DELTA_NOT_ZERO' AS code FROM p WHERE conversation_id % 5 = 0 UNION ALL SELECT conversation_id, 'INVALID_RESPONSE_SESSION_COUNT_NOT_ZERO' FROM p WHERE conversation_id % 7 = 0 UNION ALL SELECT conversation_id, 'PROCESSING_RUN_NOT_LATEST' FROM p WHERE conversation_id % 11 = 0
      UNION ALL SELECT conversation_id, 'MEMBERSHIPS_UNACCOUNTED' FROM p WHERE conversation_id % 3 = 0 OR conversation_id % 17 = 0 UNION ALL SELECT conversation_id, 'RECONCILIATION_DUPLICATE' FROM p GROUP BY 1 HAVING count(*) > 1
      UNION ALL SELECT conversation_id, CASE WHEN ok IS NULL THEN 'RECONCILIATION_ROW_MISSING' ELSE 'RECONCILIATION_NOT_OK' END FROM w WHERE ok IS DISTINCT FROM 1""",
    "analytics_oracle": f"""WITH {ad.SQL_SPARSE}, p AS (SELECT DISTINCT sender_id AS p FROM msg), c AS (SELECT unnest([struct_pack(code := 'ROW_MISSING', n := count(*) FILTER (WHERE p % 7 = 0)), struct_pack(code := 'ROW_UNEXPECTED', n := 0::BIGINT), struct_pack(code := 'TURN_COUNT_DIFFERS', n := 0::BIGINT),
      struct_pack(code := 'MESSAGE_COUNT_DIFFERS', n := count(*) FILTER (WHERE p % 10 = 0 AND p % 7 <> 0))]) AS c FROM p) SELECT c.code AS code, c.n AS n, CASE WHEN c.n > 0 THEN 'ERROR' ELSE 'OK' END AS severity FROM c""",
    "schema_actions": "SELECT n_name AS object, CASE WHEN n_name IN ('FRANCE', 'ALGERIA') THEN 'leave' WHEN n_regionkey = 2 THEN 'create' WHEN n_regionkey < 3 THEN 'rebuild' WHEN n_regionkey > 3 THEN 'refuse' ELSE 'keep' END AS action FROM nation WHERE n_regionkey <> 2 OR n_name NOT IN ('FRANCE', 'ALGERIA')",
    "backfilled_sources": f"{_with('import_run', 'message', 'message_source', 'legacy')}, {_SOURCES} SELECT * FROM cs",
    "backfilled_links": f"{_with('import_run', 'message', 'message_source', 'legacy', 'membership')}, {_SOURCES} SELECT message_source_id, conversation_source_id, membership_id, 0::BIGINT AS position FROM message_source s JOIN import_run r ON r.import_run_id = s.import_run_id JOIN cs ON cs.source_type = s.source_type AND cs.source_snapshot_key = {_RUN_KEY} AND cs.source_conversation_id = s.source_conversation_id JOIN membership b ON b.message_id = s.message_id AND b.conversation_id = cs.conversation_id WHERE s.source_conversation_id <> ''",
    "backfilled_sha": "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'own' WHEN event_id % 4 <> 0 THEN 's' || event_id END AS source_sha256 FROM events",
    "gate_report": f"{_ACCOUNTS}, o AS (SELECT CASE WHEN bool_or(severity = 'ERROR') THEN 'FAIL' ELSE 'PASS' END AS status, to_json(struct_pack(checks := list(struct_pack(code := code, n := n, severity := severity) ORDER BY code), status := CASE WHEN bool_or(severity = 'ERROR') THEN 'FAIL' ELSE 'PASS' END))::VARCHAR AS report FROM s) SELECT status, report, sha256(report) AS fingerprint FROM o",
}
