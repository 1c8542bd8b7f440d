"""Queries of keys, parsing, identities, duplicates, threads, views, audits and readers, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import canonical as ca
from ..operators import readers as rd
from ..operators import structure as st
from ..operators import views as vw
from . import adapters as ad
from .store import TABLES


def stable_keys(spark, sf_dir: str) -> DataFrame:
    e = ad.table(spark, sf_dir, "events")
    return e.select("event_id", ca.source_record_key(F.when(F.col("event_id") % 2 == 0, "imessage_chat_db").otherwise("generic_csv"), F.col("event_type"), F.when(F.col("event_id") % 5 != 0, F.col("props")), F.col("event_id"), F.col("user_id")).alias("source_record_key"))


def apple_time(spark, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("event_id") % 3 == 0, F.col("event_id") * 1000).otherwise(F.col("event_id") * 1_000_000_000 + 600_000_000_000_000_000)
    return ad.table(spark, sf_dir, "events").select("event_id", ca.apple_time_us(raw).alias("us"), ca.apple_time_precision(raw).alias("precision"))


def timestamp_parse(spark, sf_dir: str) -> DataFrame:
    e = ad.table(spark, sf_dir, "events")
    iso = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    i = F.col("event_id") % 6
    raw = F.when(i == 0, F.concat(iso, F.lit("Z"))).when(i == 1, F.concat(iso, F.lit("+02:00"))).when(i == 2, F.concat(F.left(iso, F.lit(19)), F.lit("-0530"))).when(i == 3, iso).when(i == 4, F.col("event_id").cast("string")).otherwise(F.col("event_type"))
    return e.select("event_id", ca.parse_timestamp(raw).alias("t")).select("event_id", "t.us", "t.precision", ca.canonical_precision(F.col("t.precision")).alias("canonical"))


def direction_parse(spark, sf_dir: str) -> DataFrame:
    words = F.array(*[F.lit(x) for x in ("Outgoing", " sent", "ME", "received", "no", "0", "1", "maybe", "")])
    return ad.table(spark, sf_dir, "events").select("event_id", ca.parse_direction(F.get(words, (F.col("event_id") % 9).cast("int"))).alias("outgoing"))


_IDENTITY = "CASE user_id % 4 WHEN 0 THEN 'User' || user_id || '@Mail.Example' WHEN 1 THEN '00420 (603) 12-' || user_id WHEN 2 THEN '+420 60312' || user_id ELSE 'handle.' || user_id END"


def identity_norm(spark, sf_dir: str) -> DataFrame:
    raw = F.expr(_IDENTITY)
    return ad.table(spark, sf_dir, "events").select("event_id", ca.identity_type(raw).alias("identity_type"), ca.normalized_identity(raw).alias("normalized_value"))


def participant_ids(spark, sf_dir: str) -> DataFrame:
    rows = ad.table(spark, sf_dir, "events").select(F.expr(_IDENTITY).alias("identity"), (F.col("event_id") % 97 == 0).alias("is_self"))
    return ca.participants(rows)


def conversation_keys(spark, sf_dir: str) -> DataFrame:
    e = ad.table(spark, sf_dir, "events")
    snap = ca.snapshot_key(F.when(F.col("event_id") % 2 == 0, F.col("event_type")), F.col("event_type"))
    return e.select("event_id", snap.alias("snapshot_key"), ca.conversation_key(F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("chat:"), F.col("user_id").cast("string"))), F.lit("generic"), snap, F.col("user_id")).alias("conversation_key"))


def conversation_refs(spark, sf_dir: str) -> DataFrame:
    ref = lambda n: f"named_struct('conversation_key', CAST(NULL AS STRING), 'conversation_id', CASE WHEN event_id % 4 = {n} THEN CAST(user_id AS STRING) END, 'guid', CASE WHEN event_id % 3 <> {n} THEN concat('g', user_id % 7) END, 'rowid', event_id % {n + 2}, 'canonical_key', CAST(NULL AS STRING))"
    rows = ad.table(spark, sf_dir, "events").select(F.col("event_id").alias("record_id"), F.lit("imessage").alias("source_type"), F.expr(f"array({ref(0)}, {ref(1)}, {ref(0)})").alias("refs"))
    return ca.conversation_refs(rows)


def records_to_resolve(e: DataFrame) -> DataFrame:
    """Three events share a record key, and some a guid."""
    return e.select(F.col("event_id").alias("source_pk"), F.lit("csv").alias("source_type"), (F.floor(F.col("event_id") / 3)).cast("string").alias("source_record_key"), F.when(F.col("event_id") % 2 == 0, "sms").alias("service"), F.when(F.col("event_id") % 5 == 0, (F.col("event_id") % 1000).cast("string")).alias("guid"))


def resolved_messages(spark, sf_dir: str) -> DataFrame:
    return ca.resolve_messages(records_to_resolve(ad.table(spark, sf_dir, "events"))).select("source_pk", "canonical_id")


def attachments(spark, sf_dir: str) -> DataFrame:
    e = ad.table(spark, sf_dir, "events")
    rows = e.select(F.col("event_id").cast("string").alias("record_key"), (F.col("event_id") % 3).alias("position"), F.when(F.col("event_id") % 2 == 0, F.col("event_id")).alias("attachment_id"), F.when(F.col("event_id") % 5 != 0, F.sha2(F.col("event_type"), 256)).alias("sha256"))
    return ca.attachment_occurrences(rows).groupBy("blob_key").agg(F.count("*").alias("occurrences"), F.min("occurrence_key").alias("first_occurrence"))


def reply_relations(spark, sf_dir: str) -> DataFrame:
    e = ad.table(spark, sf_dir, "events")
    rows = e.select(F.col("event_id").alias("message_id"), F.when(F.col("event_id") % 4 != 0, "sms").alias("service"), F.concat(F.lit("g"), F.col("event_id").cast("string")).alias("guid"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("g"), (F.col("event_id") - 4).cast("string"))).alias("reply_to_guid"))
    return ca.reply_relations(rows)


def local_time(spark, sf_dir: str) -> DataFrame:
    e = ad.table(spark, sf_dir, "events")
    iso = F.concat(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss"), F.get(F.array(F.lit("+02:00"), F.lit("Z"), F.lit("-05:30"), F.lit("+15:00"), F.lit("")), (F.col("event_id") % 5).cast("int")))
    rows = e.select("event_id", F.when(F.col("event_id") % 7 != 0, iso).alias("local_iso"), F.when(F.col("event_id") % 2 == 0, 120).alias("stated_offset_min"))
    return ca.local_time(rows).select("event_id", "iso_offset_min", "offset_min", "iso_ok", "conflict")


def participant_resolution(spark, sf_dir: str) -> DataFrame:
    return st.resolved_participants(ad.people(spark, sf_dir))


def name_candidates(spark, sf_dir: str) -> DataFrame:
    return st.name_candidates(ad.people(spark, sf_dir), normalize=False)


def duplicate_candidates(spark, sf_dir: str) -> DataFrame:
    return st.duplicate_pairs(ad.repeated(spark, sf_dir))


def duplicate_groups(spark, sf_dir: str) -> DataFrame:
    """White space and control characters around some copies, attachments at some: copies are such only with the same attachments."""
    i = F.col("message_id")
    m = ad.repeated(spark, sf_dir).withColumn("text", F.when(i % 3 == 0, F.concat(F.lit(" \u0000"), "text", F.lit(" \n"))).otherwise(F.col("text")))
    a = m.where("message_id % 4 = 0").select("message_id", F.explode(F.array(F.lit("b"), F.when(i % 8 == 0, "a").otherwise("b"))).alias("attachment_key"))
    return st.duplicate_pairs(st.duplicate_groups(m, a), same=("clean_text", "attachment_keys"))


def analytic_read(spark, sf_dir: str) -> DataFrame:
    m = ad.memberships(spark, sf_dir).select("membership_id", "message_id", "conversation_id", "is_primary")
    processed = ad.memberships(spark, sf_dir).where("message_id % 13 <> 0").select("membership_id", F.when(F.col("message_id") % 17 == 0, -1).otherwise(F.col("message_id")).cast("bigint").alias("message_id"), "conversation_id", F.length("text").alias("char_count"))
    return vw.analytic_read(m, processed)


def evidence_resolution(spark, sf_dir: str) -> DataFrame:
    m = ad.sparse(spark, sf_dir).select("conversation_id", "message_id")
    wanted = m.where("message_id % 2 = 0").unionByName(m.select("conversation_id", (F.col("message_id") + 1).alias("message_id")).where("message_id % 10 = 0"))
    found, missing = vw.resolve_evidence(m, wanted)
    return found.withColumn("found", F.lit(True)).unionByName(missing.withColumn("found", F.lit(False)))


def inventory_details(spark, sf_dir: str) -> DataFrame:
    from .store import store

    s, m = store(spark, sf_dir), ad.sparse(spark, sf_dir)
    of = m.where("sender_id IS NOT NULL").select("conversation_id", F.col("sender_id").alias("participant_id")).distinct().join(ad.people(spark, sf_dir), "participant_id")
    sources = s["conversation_source"].select("conversation_id", "source_type", F.coalesce("source_sha256", F.lit("none")).alias("source_snapshot_key"), "source_conversation_id")
    rows = rd.inventory_details(m, of, sources)
    people = F.array_join(F.transform("participants", lambda x: F.concat_ws("/", x.participant_id.cast("string"), x.canonical_name, x.is_self.cast("string"))), ",")
    return rows.withColumns({"participants": people, "sources": F.array_join(F.transform("sources", lambda x: F.concat_ws("/", x.source_type, x.source_snapshot_key, x.source_conversation_id)), ",")})


def interval_merge(spark, sf_dir: str) -> DataFrame:
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    e = ad.table(spark, sf_dir, "events")
    return rd.merge_candidates(e.select(F.floor(F.col("user_id") / 2).alias("conversation_id"), F.col("event_type").alias("kind"), us.alias("start_us"), F.when(F.col("event_id") % 71 != 0, us + F.col("event_id") % 400 * 3_600_000_000).alias("end_us"), F.col("value").alias("importance")))


def reply_threads(spark, sf_dir: str) -> DataFrame:
    m = ad.chats(spark, sf_dir)
    return st.reply_threads(st.reply_edges(ad.replies(spark, sf_dir), m), st.structured(m))


def media_class(spark, sf_dir: str) -> DataFrame:
    mimes = F.array(*[F.lit(x) for x in ("image/gif", "image/png", "VIDEO/mp4", "audio/aac", "application/pdf", "x/y", "")])
    names = F.array(*[F.lit(x) for x in ("a.GIF", "b.jpeg", "c.mov", "d.mp3", "e.docx", "f.unknown", "noext", ".png", "dir.zip/g")])
    return ad.table(spark, sf_dir, "events").select("event_id", tx.media_class(F.get(mimes, (F.col("event_id") % 7).cast("int")), F.get(names, (F.col("event_id") % 9).cast("int"))).alias("media_class"))


def analysis_messages(spark, sf_dir: str) -> DataFrame:
    m = ad.memberships(spark, sf_dir)
    messages = ad.events(spark, sf_dir).select("message_id", "sender_id", "timestamp_us", "text")
    return vw.analysis_messages(m.select("membership_id", "message_id", "conversation_id", "is_primary"), messages, ad.people(spark, sf_dir))


def analysis_conversations(spark, sf_dir: str) -> DataFrame:
    m = ad.memberships(spark, sf_dir)
    conversations = spark.range(-3, 2000).select(F.col("id").alias("conversation_id"))
    members = m.select("conversation_id", F.col("sender_id").alias("participant_id")).distinct()
    return vw.analysis_conversations(conversations, m.select("conversation_id", "message_id"), ad.events(spark, sf_dir), members)


def _runs(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = ad.events(spark, sf_dir).select("conversation_id", (F.col("message_id") % 5 + F.col("conversation_id") % 2).alias("run_id"), "message_id")
    runs = spark.range(0, 7).select(F.col("id").alias("run_id"), F.when(F.col("id") == 5, "failed").otherwise("completed").alias("status"))
    return rows, runs


def latest_run_per_conversation(spark, sf_dir: str) -> DataFrame:
    return vw.latest_run_per_conversation(*_runs(spark, sf_dir)).groupBy("conversation_id", "run_id").agg(F.count("*").alias("n"))


def latest_run(spark, sf_dir: str) -> DataFrame:
    rows, runs = _runs(spark, sf_dir)
    return vw.latest_run(rows, runs.where("run_id < 5")).select("conversation_id", "message_id", "run_id")


def integrity_antijoins(spark, sf_dir: str) -> DataFrame:
    lines, orders, parts = (ad.table(spark, sf_dir, t) for t in ("lineitem", "orders", "part"))
    some = orders.where("o_orderkey % 10 <> 0")
    return vw.issues(vw.orphans(lines, some, {"l_orderkey": "o_orderkey"}, "line_without_order"), vw.orphans(lines, parts, {"l_partkey": "p_partkey"}, "line_without_part"), vw.orphans(orders, ad.table(spark, sf_dir, "customer"), {"o_custkey": "c_custkey"}, "order_without_customer"))


def multiset_diff(spark, sf_dir: str) -> DataFrame:
    e = ad.table(spark, sf_dir, "events")
    left = e.select("user_id", "event_type")
    right = e.where("event_id % 11 <> 0").select("user_id", "event_type")
    return vw.multiset_diff(left, right).groupBy("user_id", "event_type", "side").agg(F.count("*").alias("n"))


def evidence_audit(spark, sf_dir: str) -> DataFrame:
    m = ad.events(spark, sf_dir).select("conversation_id", "message_id")
    derived = m.where("message_id % 100 = 0").select("conversation_id", F.array("message_id", F.col("message_id") + 1, F.lit(-1).cast("bigint")).alias("source_message_ids"))
    return vw.evidence_audit(derived, m).select("conversation_id", "message_id")


def primary_audit(spark, sf_dir: str) -> DataFrame:
    m = ad.memberships(spark, sf_dir).withColumn("is_primary", F.col("is_primary") | (F.col("message_id") % 80 == 0))
    return vw.primary_audit(m)


def reconciliation(spark, sf_dir: str) -> DataFrame:
    p = ad.sparse(spark, sf_dir)
    known = p.where("sender_id IS NOT NULL").groupBy("conversation_id", "sender_id").agg(F.count("*").alias("message_count"))
    return vw.reconciliation(known, p)


def fingerprint(spark, sf_dir: str) -> DataFrame:
    return vw.fingerprints(ad.sparse(spark, sf_dir), ["message_id", "sender_id", "timestamp_us", "text"])


def incremental_changed(spark, sf_dir: str) -> DataFrame:
    m = ad.events(spark, sf_dir)
    columns = ["message_id", "sender_id", "text"]
    mark = lambda df: vw.fingerprints(df, columns).withColumns({"signature": F.lit("v1"), "run_id": F.lit(1)})
    return vw.changed_conversations(mark(m), mark(m.withColumn("text", F.when(F.col("message_id") % 997 == 0, F.lit("?")).otherwise(F.col("text"))))).select("conversation_id")


def resolved_sender_audit(spark, sf_dir: str) -> DataFrame:
    m = ad.sparse(spark, sf_dir)
    sidecar = m.where("message_id % 13 <> 0").select("membership_id", F.when(F.col("message_id") % 19 != 0, F.col("sender_id")).alias("resolved_id"))
    return vw.resolved_senders(m, sidecar)[1]


def message_filter(spark, sf_dir: str) -> DataFrame:
    rows = rd.message_filter(ad.sparse(spark, sf_dir), 1_704_500_000_000_000, 1_705_500_000_000_000, (1, 2, 3, 5, 8), "PURCHASE")
    return rows.select("membership_id", "sender_id", "timestamp_us")


def contact_overview(spark, sf_dir: str) -> DataFrame:
    return rd.conversation_overview(ad.sparse(spark, sf_dir))


def conversation_inventory(spark, sf_dir: str) -> DataFrame:
    return rd.inventory(ad.sparse(spark, sf_dir))


def opposite_sender_gap(spark, sf_dir: str) -> DataFrame:
    return rd.opposite_sender_gaps(ad.sparse(spark, sf_dir))


def evidence_window(spark, sf_dir: str) -> DataFrame:
    s = st.sequence_numbers(ad.sparse(spark, sf_dir))
    return rd.around_evidence(s, s.where("message_id % 100 = 0"), 3).select("membership_id", "conversation_id", "sequence_number", "is_evidence")


def context_window(spark, sf_dir: str) -> DataFrame:
    m = ad.sparse(spark, sf_dir)
    r = m.where("message_id % 100 = 0 AND timestamp_us IS NOT NULL").select(F.col("message_id").alias("request_id"), "conversation_id", F.when(F.col("message_id") % 200 == 0, "conflict").otherwise("change").alias("analysis"), F.col("timestamp_us").alias("start_us"), (F.col("timestamp_us") + 1_000_000).alias("end_us"))
    return rd.context_window(m, r).groupBy("request_id").agg(F.count("*").alias("n"), F.min("timestamp_us").alias("first_us"), F.max("timestamp_us").alias("last_us"))


def question_route(spark, sf_dir: str) -> DataFrame:
    q = F.array(*[F.lit(x) for x in ("Kolik zpráv?", "Proč je  konflikt", "Kdy se  změnilo to?", "kolik a proč", "hello", "")])
    return ad.table(spark, sf_dir, "events").select("event_id", tx.question_route(F.get(q, (F.col("event_id") % 6).cast("int"))).alias("route"))


def clean_text(spark, sf_dir: str) -> DataFrame:
    noisy = F.concat(F.lit("  \r\n"), F.replace(F.col("text"), F.lit(". "), F.lit(".  \t\r\n")), F.lit(" \u0000\u0085 "))
    return ad.table(spark, sf_dir, "documents").select("doc_id", F.md5(tx.clean_text(noisy)).alias("cleaned_md5"))


def safe_excerpt(spark, sf_dir: str) -> DataFrame:
    return ad.table(spark, sf_dir, "documents").select("doc_id", tx.excerpt(F.col("text")).alias("excerpt"))


def text_blocks(spark, sf_dir: str) -> DataFrame:
    from ..sources.text import blocks

    d = ad.table(spark, sf_dir, "documents").select("doc_id", "text")
    return blocks(d, "doc_id", "line").groupBy("doc_id").agg(F.count("*").alias("lines"), F.sum(F.length("text")).alias("chars"), F.min("ordinal").alias("first_ordinal"))


def disposition(spark, sf_dir: str) -> DataFrame:
    e = ad.table(spark, sf_dir, "events").select("event_id", F.col("value").alias("importance"), F.when(F.col("event_id") % 50 == 0, "ignore").alias("override"))
    return rd.candidate_disposition(e).select("event_id", "disposition")


_SPARSE = f"WITH {ad.SQL_SPARSE}"
_RAW = "raw AS (SELECT event_id, " + _IDENTITY + " AS r FROM events), i AS (SELECT event_id, CASE WHEN contains(r, '@') THEN 'email' WHEN regexp_full_match(regexp_replace(r, '[ +().-]', '', 'g'), '\\d+') THEN 'phone' ELSE 'imessage_handle' END AS identity_type, CASE WHEN contains(r, '@') THEN lower(trim(r)) ELSE regexp_replace(regexp_replace(trim(r), '[\\s().-]+', '', 'g'), '^00', '+') END AS normalized_value FROM raw)"
_U = "chr(31)"
_REF = "struct_pack(k := NULL::VARCHAR, i := CASE WHEN event_id % 4 = {0} THEN user_id::VARCHAR END, g := CASE WHEN event_id % 3 <> {0} THEN 'g' || (user_id % 7) END, r := event_id % {1})"

QUERIES = {f.__name__: f for f in (
    stable_keys, apple_time, timestamp_parse, direction_parse, identity_norm, participant_ids, conversation_keys, conversation_refs, resolved_messages, attachments, reply_relations, local_time, participant_resolution, name_candidates,
    duplicate_candidates, duplicate_groups, analytic_read, evidence_resolution, inventory_details, interval_merge, reply_threads, media_class, analysis_messages, analysis_conversations, latest_run_per_conversation, latest_run, integrity_antijoins, multiset_diff, evidence_audit, primary_audit, reconciliation, fingerprint,
    incremental_changed, resolved_sender_audit, message_filter, contact_overview, conversation_inventory, opposite_sender_gap, evidence_window, context_window, question_route, clean_text, safe_excerpt, text_blocks, disposition,
)}
ORACLES = {
    "stable_keys": f"SELECT event_id, CASE WHEN event_id % 2 = 0 THEN sha256(event_type || {_U} || 'message' || {_U} || event_id) ELSE sha256(event_type || {_U} || coalesce(CASE WHEN event_id % 5 <> 0 THEN props END, '') || {_U} || event_id || {_U} || user_id) END AS source_record_key FROM events",
    "apple_time": "WITH r AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_id * 1000 ELSE event_id * 1000000000 + 600000000000000000 END AS x FROM events) SELECT event_id, CASE WHEN abs(x) >= 100000000000 THEN x // 1000 + 978307200000000 ELSE (x + 978307200) * 1000000 END AS us, CASE WHEN abs(x) >= 100000000000 THEN 'nanosecond' ELSE 'second' END AS precision FROM r",
    "timestamp_parse": "WITH b AS (SELECT event_id, epoch_us(ts) AS u, event_id % 6 AS i FROM events) SELECT event_id, CASE i WHEN 0 THEN u WHEN 1 THEN u - 7200000000 WHEN 2 THEN (u - u % 1000000) + 19800000000 END AS us, CASE i WHEN 0 THEN 'microsecond' WHEN 1 THEN 'microsecond' WHEN 2 THEN 'second' WHEN 3 THEN 'local_text' WHEN 4 THEN 'numeric_unknown' ELSE 'text' END AS precision, CASE WHEN i < 2 THEN 'microsecond' WHEN i = 2 THEN 'second' ELSE 'unknown' END AS canonical FROM b",
    "direction_parse": "SELECT event_id, CASE WHEN event_id % 9 IN (0, 1, 2, 6) THEN true WHEN event_id % 9 IN (3, 4, 5) THEN false END AS outgoing FROM events",
    "identity_norm": f"WITH {_RAW} SELECT * FROM i",
    "participant_ids": f"WITH {_RAW}, g AS (SELECT identity_type, normalized_value, bool_or(event_id % 97 = 0) AS is_self, count(*) AS records FROM i GROUP BY 1, 2) SELECT row_number() OVER (ORDER BY identity_type, normalized_value) AS participant_id, * FROM g",
    "conversation_keys": f"SELECT event_id, s AS snapshot_key, CASE WHEN user_id % 3 = 0 THEN 'chat:' || user_id ELSE sha256('generic' || {_U} || s || {_U} || user_id) END AS conversation_key FROM (SELECT *, CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'fingerprint:' || event_type END AS s FROM events)",
    "conversation_refs": f"WITH a AS (SELECT event_id AS record_id, unnest([{_REF.format(0, 2)}, {_REF.format(1, 3)}, {_REF.format(0, 2)}]) AS x, unnest([0, 1, 2]) AS position FROM events), b AS (SELECT record_id, position::BIGINT AS position, coalesce(x.k, x.i, 'guid:' || x.g, 'rowid:' || x.r) AS conversation_key, 'imessage:chat-guid:' || x.g AS canonical_key FROM a), c AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY record_id, conversation_key, canonical_key ORDER BY position) = 1) SELECT record_id, position, conversation_key, canonical_key, row_number() OVER (PARTITION BY record_id ORDER BY position) = 1 AS is_primary FROM c",
    "attachments": "WITH a AS (SELECT event_id || ':attachment:' || coalesce(CASE WHEN event_id % 2 = 0 THEN event_id END, event_id % 3) || ':position:' || (event_id % 3) AS k, CASE WHEN event_id % 5 <> 0 THEN sha256(event_type) END AS s FROM events) SELECT coalesce(s, 'occurrence:' || k) AS blob_key, count(*) AS occurrences, min(k) AS first_occurrence FROM a GROUP BY 1",
    "reply_relations": "WITH m AS (SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN 'sms' END AS s FROM events) SELECT a.event_id AS source_message_id, b.event_id AS target_message_id, 'reply_to' AS relation_type FROM m a JOIN m b ON b.event_id = a.event_id - 4 AND a.s IS NOT DISTINCT FROM b.s WHERE a.event_id % 3 = 0",
    "local_time": "WITH a AS (SELECT event_id, event_id % 7 <> 0 AS has, CASE event_id % 5 WHEN 0 THEN 120 WHEN 1 THEN 0 WHEN 2 THEN -330 WHEN 3 THEN 900 END AS o, CASE WHEN event_id % 2 = 0 THEN 120 END AS st FROM events), b AS (SELECT event_id, has, CASE WHEN has THEN o END::BIGINT AS o, st::BIGINT AS st FROM a) SELECT event_id, o AS iso_offset_min, coalesce(st, o) AS offset_min, NOT has OR (o IS NOT NULL AND o BETWEEN -840 AND 840) AS iso_ok, st IS NOT NULL AND o IS NOT NULL AND st <> o AS conflict FROM b",
    "participant_resolution": "WITH p AS (SELECT DISTINCT user_id FROM events), s AS (SELECT min(user_id) AS m FROM p WHERE user_id % 50 = 0) SELECT user_id AS participant_id, CASE WHEN user_id % 50 = 0 THEN m ELSE user_id END AS resolved_id, CASE WHEN user_id % 50 = 0 THEN 'explicit_is_self_union' ELSE 'identity' END AS method FROM p, s",
    "name_candidates": "WITH p AS (SELECT DISTINCT user_id FROM events), s AS (SELECT min(user_id) AS m FROM p WHERE user_id % 50 = 0), r AS (SELECT user_id, CASE WHEN user_id % 50 = 0 THEN m ELSE user_id END AS res, user_id % 40 AS n FROM p, s), w AS (SELECT *, lag(user_id) OVER c AS l, lag(res) OVER c AS lr FROM r WINDOW c AS (PARTITION BY n ORDER BY user_id)) SELECT l AS left_id, user_id AS right_id, 0.35::DOUBLE AS confidence FROM w WHERE l IS NOT NULL AND lr <> res",
    "duplicate_candidates": f"""WITH {ad.SQL_EVENTS}, c AS (SELECT conversation_id, sender_id, text, message_id, timestamp_us, source_message_id FROM msg UNION ALL SELECT conversation_id, sender_id, text, message_id + 1000000000, timestamp_us + 1000000, 'x' || (message_id + 1000000000) FROM msg WHERE message_id % 50 = 0
  UNION ALL SELECT conversation_id, sender_id, text, message_id + 2000000000, timestamp_us + 1000000, source_message_id FROM msg WHERE message_id % 50 = 0),
  a AS (SELECT *, min(message_id) OVER (PARTITION BY conversation_id, sender_id, text, source_message_id) AS f, lag(message_id) OVER w AS li, lag(timestamp_us) OVER w AS lu, lag(source_message_id) OVER w AS ls FROM c WINDOW w AS (PARTITION BY conversation_id, sender_id, text ORDER BY timestamp_us, message_id))
  SELECT f AS left_id, message_id AS right_id, 'same_source_id' AS kind, 1.0::DOUBLE AS confidence FROM a WHERE f <> message_id UNION SELECT least(li, message_id), greatest(li, message_id), 'near_in_time', 0.8::DOUBLE FROM a WHERE timestamp_us - lu <= 2000000 AND ls IS DISTINCT FROM source_message_id""",
    "duplicate_groups": f"""WITH {ad.SQL_EVENTS}, c AS (SELECT conversation_id, sender_id, text, message_id, timestamp_us, source_message_id FROM msg UNION ALL SELECT conversation_id, sender_id, text, message_id + 1000000000, timestamp_us + 1000000, 'x' || (message_id + 1000000000) FROM msg WHERE message_id % 50 = 0
  UNION ALL SELECT conversation_id, sender_id, text, message_id + 2000000000, timestamp_us + 1000000, source_message_id FROM msg WHERE message_id % 50 = 0), k AS (SELECT *, CASE WHEN message_id % 8 = 0 THEN 'ab' WHEN message_id % 4 = 0 THEN 'bb' ELSE '' END AS ak FROM c),
  a AS (SELECT *, min(message_id) OVER (PARTITION BY conversation_id, sender_id, text, ak, source_message_id) AS f, lag(message_id) OVER w AS li, lag(timestamp_us) OVER w AS lu, lag(source_message_id) OVER w AS ls FROM k WINDOW w AS (PARTITION BY conversation_id, sender_id, text, ak ORDER BY timestamp_us, message_id))
  SELECT f AS left_id, message_id AS right_id, 'same_source_id' AS kind, 1.0::DOUBLE AS confidence FROM a WHERE f <> message_id UNION SELECT least(li, message_id), greatest(li, message_id), 'near_in_time', 0.8::DOUBLE FROM a WHERE timestamp_us - lu <= 2000000 AND ls IS DISTINCT FROM source_message_id""",
    "resolved_messages": "WITH k AS (SELECT event_id // 3 AS t, min(event_id) AS m, max(CASE WHEN event_id % 5 = 0 THEN event_id % 1000 END) AS g FROM events GROUP BY 1), c AS (SELECT t, CASE WHEN g IS NULL THEN m ELSE min(m) OVER (PARTITION BY g) END AS canonical_id FROM k) SELECT event_id AS source_pk, canonical_id FROM events JOIN c ON t = event_id // 3",
    "fingerprint": f"{_SPARSE}, h AS (SELECT conversation_id, sha256(to_json(struct_pack(message_id := message_id, sender_id := sender_id, timestamp_us := timestamp_us, text := text))::VARCHAR) AS h FROM msg) SELECT conversation_id, sha256(concat_ws(':', count(*), {', '.join(f"sum(('0x' || substr(h, {1 + 12 * i}, 12))::BIGINT)" for i in range(5))})) AS fingerprint FROM h GROUP BY 1",
    "interval_merge": """WITH RECURSIVE c AS (SELECT user_id // 2 AS conversation_id, event_type AS kind, epoch_us(ts) AS s, epoch_us(ts) + event_id % 400 * 3600000000 AS e, value AS v, row_number() OVER (PARTITION BY user_id // 2, event_type ORDER BY epoch_us(ts), epoch_us(ts) + event_id % 400 * 3600000000, value) AS n FROM events WHERE event_id % 71 <> 0),
""" + ad.SQL_FOLD,
    "analytic_read": f"WITH {ad.SQL_EVENTS}, mb AS (SELECT membership_id, message_id, conversation_id, true AS is_primary, text FROM msg UNION ALL SELECT membership_id + 1000000000, message_id, conversation_id + 1000, false, text FROM msg WHERE message_id % 40 = 0) SELECT membership_id, message_id, conversation_id, is_primary, length(text) AS char_count FROM mb WHERE message_id % 13 <> 0 AND message_id % 17 <> 0",
    "evidence_resolution": "WITH w AS (SELECT DISTINCT user_id // 2 AS conversation_id, event_id AS message_id FROM events WHERE event_id % 2 = 0 UNION SELECT user_id // 2, event_id + 1 FROM events WHERE (event_id + 1) % 10 = 0) SELECT w.conversation_id, w.message_id, e.event_id IS NOT NULL AS found FROM w LEFT JOIN events e ON e.event_id = w.message_id AND e.user_id // 2 = w.conversation_id",
    "inventory_details": f"""WITH {ad.SQL_SPARSE}, cs AS ({TABLES["conversation_source"]}), p AS (SELECT conversation_id, string_agg(DISTINCT sender_id || '/User ' || (sender_id % 40) || '/' || CASE WHEN sender_id % 50 = 0 THEN 'true' ELSE 'false' END, ',' ORDER BY sender_id || '/User ' || (sender_id % 40) || '/' || CASE WHEN sender_id % 50 = 0 THEN 'true' ELSE 'false' END) AS participants FROM msg WHERE sender_id IS NOT NULL GROUP BY 1),
  s AS (SELECT conversation_id, string_agg(source_type || '/' || coalesce(source_sha256, 'none') || '/' || source_conversation_id, ',' ORDER BY source_type, coalesce(source_sha256, 'none'), source_conversation_id) AS sources FROM cs GROUP BY 1), g AS (SELECT conversation_id, count(*) AS message_count, count(*) FILTER (WHERE timestamp_us IS NULL) AS unknown_time_count, min(timestamp_us) AS first_us, max(timestamp_us) AS last_us FROM msg GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100)
  SELECT g.*, participants, sources FROM g LEFT JOIN p USING (conversation_id) LEFT JOIN s USING (conversation_id)""",
    "reply_threads": f"""WITH {ad.sql_processed(ad.SQL_CHATS)}, e AS (SELECT conv_id * 100 + turn AS a FROM conversations WHERE turn > 0 AND (conv_id + turn) % 3 <> 0 AND EXISTS (SELECT 1 FROM conversations q WHERE q.conv_id = conversations.conv_id AND q.turn = conversations.turn - 1)),
  n AS (SELECT a AS m FROM e UNION SELECT a - 1 FROM e), g AS (SELECT m, sum(CASE WHEN m IN (SELECT a FROM e) THEN 0 ELSE 1 END) OVER (ORDER BY m) AS k FROM n), t AS (SELECT m, min(m) OVER (PARTITION BY k) AS thread_id FROM g)
  SELECT conversation_id, thread_id, membership_id, row_number() OVER (PARTITION BY thread_id ORDER BY seq) AS position, CASE WHEN min(session_no) OVER (PARTITION BY thread_id) = max(session_no) OVER (PARTITION BY thread_id) THEN session_no END AS session_no, count(*) OVER (PARTITION BY thread_id) AS size FROM t JOIN st ON st.membership_id = t.m""",
    "media_class": "SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'gif' WHEN 1 THEN 'image' WHEN 2 THEN 'video' WHEN 3 THEN 'audio' WHEN 4 THEN 'document' ELSE CASE event_id % 9 WHEN 0 THEN 'gif' WHEN 1 THEN 'image' WHEN 2 THEN 'video' WHEN 3 THEN 'audio' WHEN 4 THEN 'document' ELSE 'other' END END AS media_class FROM events",
    "analysis_messages": f"WITH {ad.SQL_EVENTS}, mb AS (SELECT membership_id, message_id, conversation_id, true AS is_primary FROM msg UNION ALL SELECT membership_id + 1000000000, message_id, conversation_id + 1000, false FROM msg WHERE message_id % 40 = 0) SELECT mb.membership_id, mb.message_id, mb.conversation_id, is_primary, sender_id, timestamp_us, text, 'User ' || (sender_id % 40) AS sender_name, sender_id % 50 = 0 AS sender_is_self FROM mb JOIN msg USING (message_id)",
    "analysis_conversations": f"WITH {ad.SQL_EVENTS}, mb AS (SELECT message_id, conversation_id, sender_id, timestamp_us FROM msg UNION ALL SELECT message_id, conversation_id + 1000, sender_id, timestamp_us FROM msg WHERE message_id % 40 = 0), g AS (SELECT conversation_id, count(DISTINCT message_id) AS m, min(timestamp_us) AS first_us, max(timestamp_us) AS last_us, count(DISTINCT sender_id) AS p FROM mb GROUP BY 1) SELECT r.range AS conversation_id, coalesce(m, 0) AS message_count, first_us, last_us, coalesce(p, 0) AS participant_count FROM range(-3, 2000) r LEFT JOIN g ON g.conversation_id = r.range",
    "latest_run_per_conversation": "WITH m AS (SELECT user_id // 2 AS conversation_id, event_id % 5 + (user_id // 2) % 2 AS run_id FROM events), d AS (SELECT conversation_id, max(run_id) AS run_id FROM m WHERE run_id <> 5 GROUP BY 1) SELECT conversation_id, run_id, count(*) AS n FROM m JOIN d USING (conversation_id, run_id) GROUP BY 1, 2",
    "latest_run": "SELECT user_id // 2 AS conversation_id, event_id AS message_id, 4::BIGINT AS run_id FROM events WHERE event_id % 5 + (user_id // 2) % 2 = 4",
    "integrity_antijoins": "WITH c AS (SELECT 'line_without_order' AS code, count(*) AS n FROM lineitem WHERE l_orderkey IS NOT NULL AND l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 10 <> 0) UNION ALL SELECT 'line_without_part', count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part) UNION ALL SELECT 'order_without_customer', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) SELECT code, n, CASE WHEN n > 0 THEN 'ERROR' ELSE 'OK' END AS severity FROM c",
    "multiset_diff": "SELECT user_id, event_type, 'left' AS side, count(*) AS n FROM events WHERE event_id % 11 = 0 GROUP BY 1, 2",
    "evidence_audit": "WITH d AS (SELECT user_id // 2 AS conversation_id, unnest([event_id, event_id + 1, -1]) AS message_id FROM events WHERE event_id % 100 = 0) SELECT d.* FROM d LEFT JOIN events e ON e.event_id = d.message_id AND e.user_id // 2 = d.conversation_id WHERE e.event_id IS NULL",
    "primary_audit": "SELECT event_id AS message_id, 2::BIGINT AS primaries FROM events WHERE event_id % 80 = 0",
    "reconciliation": f"{_SPARSE} SELECT conversation_id, count(*) AS memberships, count(*) FILTER (WHERE sender_id IS NULL) AS unknown, count(sender_id) AS known, 0::BIGINT AS delta, true AS ok FROM msg GROUP BY 1",
    "incremental_changed": "SELECT DISTINCT user_id // 2 AS conversation_id FROM events WHERE event_id % 997 = 0",
    "resolved_sender_audit": f"{_SPARSE} SELECT membership_id FROM msg WHERE message_id % 13 = 0 OR (message_id % 19 = 0 AND sender_id IS NOT NULL)",
    "message_filter": f"{_SPARSE} SELECT membership_id, sender_id, timestamp_us FROM msg WHERE (timestamp_us BETWEEN 1704500000000000 AND 1705500000000000 OR timestamp_us IS NULL) AND sender_id IN (1, 2, 3, 5, 8) AND contains(lower(text), 'purchase')",
    "contact_overview": f"{_SPARSE} SELECT conversation_id, count(*) AS message_count, count(DISTINCT sender_id) AS sender_count, count(*) FILTER (WHERE timestamp_us IS NULL) AS unknown_time_count, min(timestamp_us) AS first_us, max(timestamp_us) AS last_us FROM msg GROUP BY 1",
    "conversation_inventory": f"{_SPARSE} SELECT conversation_id, count(*) AS message_count, count(*) FILTER (WHERE timestamp_us IS NULL) AS unknown_time_count, array_to_string(list_sort(list(DISTINCT sender_id) FILTER (WHERE sender_id IS NOT NULL)), ',') AS senders FROM msg GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100",
    "opposite_sender_gap": f"{_SPARSE}, w AS (SELECT *, lag(sender_id) OVER c AS p, lag(timestamp_us) OVER c AS u FROM msg WHERE timestamp_us IS NOT NULL WINDOW c AS (PARTITION BY conversation_id ORDER BY timestamp_us, membership_id)) SELECT conversation_id, membership_id, sender_id, p AS previous_sender_id, timestamp_us - u AS gap_us FROM w WHERE p <> sender_id AND timestamp_us - u BETWEEN 0 AND 259200000000",
    "evidence_window": f"WITH {ad.sql_processed(ad.SQL_SPARSE)}, h AS (SELECT conversation_id, seq FROM st WHERE message_id % 100 = 0) SELECT DISTINCT membership_id, st.conversation_id, st.seq AS sequence_number, message_id % 100 = 0 AS is_evidence FROM st JOIN h ON h.conversation_id = st.conversation_id AND st.seq BETWEEN h.seq - 3 AND h.seq + 3",
    "context_window": f"{_SPARSE}, r AS (SELECT message_id AS request_id, conversation_id AS c, timestamp_us AS t, CASE WHEN message_id % 200 = 0 THEN 24 ELSE 336 END AS b, CASE WHEN message_id % 200 = 0 THEN 24 ELSE 168 END AS a FROM msg WHERE message_id % 100 = 0 AND timestamp_us IS NOT NULL) SELECT request_id, count(*) AS n, min(timestamp_us) AS first_us, max(timestamp_us) AS last_us FROM msg JOIN r ON conversation_id = c AND timestamp_us BETWEEN t - b * 3600000000 AND t + 1000000 + a * 3600000000 GROUP BY 1",
    "question_route": "SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'data' WHEN 2 THEN 'combined' WHEN 3 THEN 'combined' ELSE 'interpretive' END AS route FROM events",
    "clean_text": r"WITH a AS (SELECT doc_id, '  ' || chr(10) || replace(text, '. ', '.' || chr(160) || ' ' || chr(9) || chr(10)) || ' ' || chr(133) || ' ' AS t FROM documents) SELECT doc_id, md5(trim(regexp_replace(regexp_replace(replace(nfc_normalize(t), chr(160), ' '), '[\x{00}-\x{08}\x{0B}-\x{1F}\x{7F}-\x{9F}]', '', 'g'), '(?m)[ \t]+$', '', 'g'), ' ' || chr(9) || chr(10))) AS cleaned_md5 FROM a",
    "safe_excerpt": r"WITH a AS (SELECT doc_id, trim(regexp_replace(text, '[\s\x{0B}\x{85}\p{Z}]+', ' ', 'g')) AS t FROM documents) SELECT doc_id, CASE WHEN length(t) <= 240 THEN t ELSE rtrim(t[:239]) || '…' END AS excerpt FROM a",
    "text_blocks": r"WITH a AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) SELECT doc_id, count(*) AS lines, sum(length(l))::BIGINT AS chars, min(i)::BIGINT AS first_ordinal FROM a WHERE regexp_matches(l, '\S') GROUP BY 1",
    "disposition": "SELECT event_id, CASE WHEN event_id % 50 = 0 THEN 'ignore' WHEN value >= 80 THEN 'analyze' WHEN value >= 60 THEN 'suggest' ELSE 'skip' END AS disposition FROM events",
}
