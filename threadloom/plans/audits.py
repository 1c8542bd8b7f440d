"""Whole audits of what is published, over tables with planted faults of every kind, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import behaviour as bh
from ..operators import evidence as ev
from ..operators import rederive as rd
from ..operators import sidecars as sc
from ..operators import snapshots as sn
from ..operators import structure as st
from ..operators import topics as tp
from ..operators import views as vw
from ..operators.graph import checkpointed, kept
from . import adapters as ad
from . import core, lexical, store

SEVERITY = "CASE WHEN n > 0 THEN 'ERROR' ELSE 'OK' END AS severity"
#: Summaries of participants with p % 31 = i have the i-th metric altered; then come rows left out, told twice, and made up.
OUT, TWICE, MADE = len(rd.METRICS), len(rd.METRICS) + 1, len(rd.METRICS) + 2
#: What turns, summaries and their second derivation read of a processed message.
READ = (
    "conversation_id", "sender_id", "message_id", "sequence_number", "session_no", "timestamp_us", "timezone_offset_min", "period_date", "utc_hour", "utc_weekday", "local_hour", "local_weekday",
    "word_count", "char_count", "question_count", "exclamation_count", "affection_count", "negative_count",
)
NULLABLE = ("mean_response_latency_seconds", *rd.QUANTILES, "median_response_effort_ratio")


def _altered(rows: DataFrame, key: Column, changes: dict[int, dict[str, Column]], out: int, twice: int, made: tuple[int, dict[str, Column]]) -> DataFrame:
    """Rows with other values where the key is that of a change; without those of `out` (and of no key), twice those of `twice`, and one more for each of `made`. Rows are read once."""
    new = {c: v for of in changes.values() for c, v in of.items()}
    k, times = F.col("_key"), lambda *n: F.array(*map(F.lit, n))
    copies = F.when(k == twice, times(0, 0)).when(k == made[0], times(0, 1)).when(k != out, times(0))
    told = rows.withColumn("_key", key).withColumn("_copy", F.explode(copies))
    told = told.withColumns({c: F.when(k.isin(*[n for n, of in changes.items() if c in of]), v).otherwise(F.col(c)) for c, v in new.items()})
    return told.withColumns({c: F.when(F.col("_copy") == 1, v).otherwise(F.col(c)) for c, v in made[1].items()}).drop("_key", "_copy")


def analytics_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything published of the events' conversations against its second derivation, with faults of each kind."""
    p = kept(st.processed(ad.sparse(spark, sf_dir), ad.EVENTS).select(*READ))
    t = kept(st.turns(p))
    r = kept(st.response_samples(t))
    s = bh.participant_summary(p, t, r, st.unanswered_turns(t), ad.EVENTS)
    c = bh.conversation_summary(p, t)
    plus = lambda name, n: F.coalesce(F.col(name), F.lit(0)) + n
    late = {"turn_no": F.col("turn_no") + 10**6}
    turns = _altered(t, F.get("message_ids", F.lit(0)) % 101, {2: {"session_no": plus("session_no", 1)}, 3: {"participant_id": plus("participant_id", 1)}, 4: {"end_us": plus("end_us", 1)}, 5: {"word_count": plus("word_count", 1)}, 6: {"message_ids": F.reverse("message_ids")}}, 0, 1, (7, late))
    effort = F.col("effort_ratio") + F.when((F.col("conversation_id") * 31 + F.col("turn_no")) % 97 == 4, 1e-8).otherwise(1e-10)
    responses = _altered(r, (F.col("conversation_id") * 31 + F.col("turn_no")) % 97, {2: {"from_id": plus("from_id", 1)}, 3: {"latency_us": F.col("latency_us") + 1}, 4: {"effort_ratio": effort}, 5: {"effort_ratio": effort}}, 0, 1, (6, late))
    step = lambda m: 2e-6 if m.endswith(("_seconds", "_ratio", "_share", "_score")) else 1
    summary = _altered(s, F.col("participant_id") % 31, {i: {m: F.col(m) + step(m)} for i, m in enumerate(rd.METRICS)}, OUT, TWICE, (MADE, {"participant_id": -F.col("participant_id") - 1}))
    conversations = _altered(c, F.col("conversation_id") % 13, {i: {m: F.col(m) + 1} for i, m in enumerate(rd.CONVERSATION)}, 4, 5, (6, {"conversation_id": -F.col("conversation_id") - 1}))
    return rd.analytics_faults(p, turns, responses, summary, conversations, ad.EVENTS)


def vertical_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as staged records with attachments and conversations, and as they were stored, with faults of each kind."""
    e = ad.table(spark, sf_dir, "events").select(F.col("event_id").alias("i"), F.floor(F.col("user_id") / 2).cast("string").alias("chat"))
    i = F.col("i")
    named = lambda letter: F.concat(F.lit(letter), i.cast("string"))
    key = named("k").alias("source_record_key")
    pair, none = F.array(named("a"), named("b")), F.array().cast("array<string>")
    staged = e.where(i % 211 != 0).select(key, F.when(i % 10 == 0, pair).when(i % 10 == 5, F.array(named("a"), named("a"))).when(i % 2 == 0, none).alias("attachments"), F.array(F.concat(F.lit("c"), "chat")).alias("conversations"))
    records = e.where(i % 223 != 0).select(key)
    files = F.when(i % 10 == 0, F.array_compact(F.array(F.when(i % 30 != 0, named("a")), named("b"), F.when(i % 70 == 0, named("z"))))).when(i % 15 == 0, F.array(named("a"))).when(i % 10 == 5, F.array(named("a"), named("a")))
    attachments = e.select(key, F.explode(files).alias("child"))
    conversations = e.select(key, F.concat(F.when(i % 101 == 0, "d").otherwise("c"), "chat").alias("child"))
    records = records.union(e.where((i % 227 == 0) & (i % 223 != 0)).select(key))
    return ev.vertical_children(staged, records, {"attachment": ("attachments", attachments), "conversation": ("conversations", conversations)})


def processing_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run over the store of store_integrity that left out memberships, took some twice, made one up and miscounted its input."""
    s = store.store(spark, sf_dir)
    m = F.col("membership_id")
    done = s["membership"].select("membership_id")
    processed = done.where(m % 37 != 0).union(done.where(m % 41 == 1)).union(spark.sql("SELECT -5L"))
    run = s["membership"].agg((F.count("*") + 1).alias("input_membership_count"), F.count_distinct("message_id").alias("canonical_message_count")).join(processed.agg(F.count("*").alias("output_membership_count")), F.lit(True))
    return ev.processing_faults(s["membership"], s["source_membership"], s["message_source"], processed, run)


def topic_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics of the chats, their evidence, markers and accounts as a reader gets them, with a fault in conversations of each remainder."""
    p = st.processed(ad.chats(spark, sf_dir), ad.CHATS)
    e = checkpointed(tp.topic_evidence(p, tp.topic_candidates(p, ad.CHATS, normalize=False), ad.CHATS, normalize=False).withColumn("topic_key", F.concat_ws(":", "n", "phrase")))
    c = F.col("conversation_id") % 11
    dated = F.col("period_date").isNotNull()
    sound = e.select("conversation_id", "topic_key", "message_id", dated.alias("dated"))
    ids = F.array_sort(F.collect_list("message_id"))
    topics = sound.groupBy("conversation_id", "topic_key").agg(ids.alias("_ids"))
    told = F.when(c == 1, F.slice("_ids", 2, 10**9)).when(c == 2, F.array_append("_ids", F.lit(-1).cast("bigint"))).when(c == 3, F.array_prepend("_ids", F.get("_ids", F.lit(0)))).otherwise(F.col("_ids"))
    topics = topics.select("conversation_id", "topic_key", told.alias("source_message_ids"))
    evidence = sound.union(sound.where(c == 4))
    marks = tp.topic_markers(p, e)
    hits = lambda name: F.when(c != 8, F.col(name))
    markers = checkpointed(marks.select("conversation_id", "topic_key", F.when(c == 10, -1).otherwise(F.col("message_id")).cast("bigint").alias("message_id"), hits("affection_count").alias("affection_hit_count"), hits("negative_count").alias("negative_hit_count")))
    of = sound.groupBy("conversation_id").agg(F.count("*").alias("evidence_row_count"), (F.count_distinct("topic_key") + F.when(F.first(c) == 5, 1).otherwise(0)).alias("topic_count"), F.count_distinct("message_id").alias("evidence_message_count"), F.count_if("dated").alias("dated_evidence_row_count"))
    accounts = of.withColumn("undated_evidence_row_count", F.col("evidence_row_count") - F.col("dated_evidence_row_count"))
    marked = markers.groupBy("conversation_id").agg(F.count("*").alias("marker_evidence_row_count"), F.count_if(F.col("affection_hit_count") > 0).alias("affection_evidence_row_count"), F.count_if(F.col("negative_hit_count") > 0).alias("negative_evidence_row_count"))
    marked = marked.where(c != 7).join(sound.groupBy("conversation_id").agg(F.count("*").alias("topic_evidence_row_count")), "conversation_id").withColumn("reconciliation_ok", F.when(c == 9, 0).otherwise(1))
    keys = topics.select("conversation_id", "topic_key")
    periods = keys.union(keys.where(c == 6).select("conversation_id", F.lit("none")).distinct())
    return ev.topic_faults(topics, evidence, accounts, periods, markers, marked, keys, keys)


def resolution_sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six tables of the events' participants, with faults in each of them."""
    people = ad.people(spark, sf_dir)
    i = F.col("participant_id")
    identities = people.select(F.explode(F.array(i * 2, i * 2 + 1)).alias("identity_id"), "participant_id").withColumns({"identity_type": F.when(F.col("identity_id") % 2 == 0, "email").otherwise("phone"), "normalized_value": F.concat(F.lit("v"), F.col("identity_id").cast("string"))})
    identities = identities.withColumn("original_value", F.upper("normalized_value"))
    processed = checkpointed(st.structured(ad.sparse(spark, sf_dir), ad.EVENTS).select("membership_id", "sender_id", (F.col("conversation_id") * 10**9 + F.col("run_no")).alias("sender_run_id")))
    want = sc.expected(people, identities, processed, normalize=False)
    change = lambda rows, c, when, value: rows.withColumn(c, F.when(when, value).otherwise(F.col(c)))
    r, a, m, s = F.col("resolved_id"), F.col("identity_id"), F.col("membership_id"), F.col("sender_run_id")
    told = {
        "members": change(want["members"].where(i % 17 != 1), "resolved_id", i % 17 == 2, r + 1).union(want["members"].where(i % 17 == 3)),
        "resolved": change(change(change(want["resolved"].where(r % 17 != 4), "is_self", r % 17 == 5, ~F.col("is_self")), "canonical_name", r % 17 == 6, F.lit("Nobody")), "confidence", r % 17 == 7, F.lit(0.9)).unionByName(want["resolved"].where(r % 17 == 8).withColumn("resolved_id", -r - 1)),
        "aliases": change(change(want["aliases"].where(a % 19 != 1), "method", a % 19 == 2, F.lit("guess")), "original_value", a % 19 == 3, F.lit(None)),
        "candidates": change(want["candidates"].where("left_id % 7 <> 1"), "confidence", F.col("left_id") % 7 == 2, F.lit(0.36)).unionByName(want["candidates"].where("left_id % 7 = 3").withColumns({"left_id": F.col("right_id"), "right_id": F.col("left_id")})),
        "message_senders": change(want["message_senders"].where(m % 23 != 1), "resolved_id", m % 23 == 2, r + 1),
        "run_senders": change(want["run_senders"].where(s % 29 != 1).drop("_most"), "resolved_id", s % 29 == 2, r + 1),
    }
    return sc.sidecar_faults(people, identities, processed, told, normalize=False)


def run_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two analytics runs, the second of the latest completed processing run, with wrong counts and sessions that are not there."""
    p = checkpointed(st.structured(ad.sparse(spark, sf_dir), ad.EVENTS))
    t = checkpointed(st.turns(st.processed(ad.sparse(spark, sf_dir), ad.EVENTS)))
    c = F.col("conversation_id")
    two = lambda rows, name: rows.withColumn(name, F.explode(F.array(F.lit(1), F.lit(2)).cast("array<bigint>")))
    lost = lambda name, when: F.when(when, F.col(name) + 10**6).otherwise(F.col(name))
    counts = p.groupBy("conversation_id").agg(F.count("*").alias("n"), F.count("sender_id").alias("k"))
    conversations = two(counts, "analytics_run_id").select("analytics_run_id", "conversation_id", (F.col("n") + F.when(c % 7 == 1, 1).otherwise(0)).alias("source_message_count"), (F.col("k") - F.when(c % 7 == 2, 1).otherwise(0)).alias("known_sender_message_count"), (F.col("n") - F.col("k")).alias("unknown_sender_message_count"))
    runs = spark.sql("SELECT stack(2, 1L, 1L, 2L, 2L) AS (analytics_run_id, processing_run_id)")
    processing = spark.sql("SELECT stack(3, 1L, 'completed', 2L, 'completed', 3L, 'failed') AS (processing_run_id, status)")
    sessions = two(p.select("conversation_id", F.col("session_no").alias("session_id")).distinct(), "processing_run_id")
    responses = two(st.response_samples(t), "analytics_run_id").select("analytics_run_id", "conversation_id", lost("session_no", (F.col("turn_no") % 11 == 0) & (F.col("analytics_run_id") == 2)).alias("session_id"))
    silences = two(bh.silence_events(t, ad.EVENTS), "analytics_run_id").select("analytics_run_id", "conversation_id", lost("session_no", c % 6 == 0).alias("previous_session_id"), lost("next_session_no", c % 4 == 0).alias("next_session_id"))
    events = two(bh.conflict_candidates(t, ad.EVENTS), "analytics_run_id").select("analytics_run_id", "conversation_id", F.when(c % 2 == 0, None).otherwise(lost("session_no", c % 5 == 1)).alias("session_id"))
    return vw.run_reconciliation(conversations, runs, processing, two(p.select("conversation_id"), "processing_run_id"), sessions, responses, silences, events)


def snapshot_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn of the events' conversations as the evidence of an assertion, with snapshots of its messages and of a metric, and faults of each kind."""
    m = checkpointed(st.processed(ad.sparse(spark, sf_dir), ad.EVENTS))
    t = checkpointed(st.turns(m).select(F.col("conversation_id").alias("context_id"), F.concat(F.lit("turn/"), F.col("turn_no").cast("string")).alias("path"), "turn_no", "message_ids"))
    x, i, k = F.col("context_id"), F.col("message_id"), F.col("turn_no")
    none = F.array().cast("array<string>")
    keyed = lambda letter: F.array(F.concat(F.lit(letter), i.cast("string")))
    messages = m.select(F.col("conversation_id").alias("context_id"), "message_id", "timestamp_us", "sender_id", "membership_id", F.when(i % 5 == 0, none).otherwise(keyed("k")).alias("source_record_keys"), keyed("s").alias("source_snapshot_keys"), F.array(F.lit("1")).alias("parser_versions"))
    ids = messages.select("context_id").distinct()
    origin = {c: F.concat(F.lit(c), x.cast("string")) for c in sn.PROVENANCE}
    contexts = ids.select("context_id", F.when(x % 13 == 1, F.array(F.lit(1))).alias("missing_message_ids"), F.when(x % 13 == 3, none).otherwise(F.array(F.lit("a"))).alias("omitted_message_ids"), F.when(x % 13 > 1, 1).otherwise(0).alias("omitted_message_count"), F.when(x % 13 != 4, "f").alias("omitted_sha256"), F.when(x % 13 != 5, F.array(F.lit("1 Omitted"))).alias("quality_warnings"), *[v.alias(c) for c, v in origin.items()])
    metrics = ids.select("context_id", F.lit("before").alias("phase"), F.lit("rate").alias("name"), (x / 3).alias("value"))
    shown = t.select("context_id", "path", "turn_no", F.posexplode("message_ids").alias("position", "message_id")).join(messages, ["context_id", "message_id"])
    shown = shown.where(i % 41 != 1).withColumns({"message_id": F.when(i % 43 == 1, -i).otherwise(i), "sender_id": F.when(i % 47 == 1, F.lit(-1)).otherwise(F.col("sender_id")), "source_record_keys": F.when(i % 53 == 1, none).otherwise(F.col("source_record_keys"))})
    of = t.select("context_id", "path", F.when(k % 17 == 1, "after").otherwise("before").alias("phase"), F.lit("rate").alias("name"), (x / 3 + F.when(k % 19 == 1, 1).otherwise(0)).alias("value"), *[(F.when(k % 23 == 1, "other").otherwise(v) if c == "analysis_signature" else v).alias(c) for c, v in origin.items()])
    evidence = t.select("context_id", "path", "message_ids").union(t.where(k == 1).select("context_id", F.lit("nothing"), F.array().cast("array<bigint>")))
    return sn.snapshot_faults(contexts, messages.union(messages.where(i % 59 == 1)), metrics, evidence, shown, of)


def _counts(table: str, cases: dict[str, str]) -> str:
    return "SELECT unnest([" + ", ".join(f"struct_pack(code := '{code}', n := count(*) FILTER (WHERE {sql}))" for code, sql in cases.items()) + f"]) AS c FROM {table}"


def _sides(name: str, key: str, out: int, twice: int, made: int) -> dict[str, str]:
    return {f"{name}_MISSING": f"{key} = {out}", f"{name}_UNEXPECTED": f"{key} = {made}", f"{name}_REPEATED": f"{key} = {twice}"}


_T, _R, _P, _C = "ids[1] % 101", "(conversation_id * 31 + turn_no) % 97", "participant_id % 31", "conversation_id % 13"
_ANALYTICS = {
    "turns": _sides("TURN", _T, 0, 1, 7) | {"TURN_SESSION_DIFFERS": f"{_T} = 2", "TURN_SENDER_DIFFERS": f"{_T} = 3", "TURN_TIME_DIFFERS": f"{_T} = 4", "TURN_COUNT_DIFFERS": f"{_T} = 5", "TURN_MESSAGES_DIFFER": f"{_T} = 6 AND message_count > 1"},
    "resp": _sides("RESPONSE", _R, 0, 1, 6) | {"RESPONSE_PARTIES_DIFFER": f"{_R} = 2", "LATENCY_DIFFERS": f"{_R} = 3 AND latency_us IS NOT NULL", "EFFORT_DIFFERS": f"{_R} = 4"},
    "sm": _sides("PARTICIPANT", _P, OUT, TWICE, MADE) | {f"{m.upper()}_DIFFERS": f"{_P} = {i}" + (f" AND {m} IS NOT NULL" if m in NULLABLE else "") for i, m in enumerate(rd.METRICS)},
    "(SELECT DISTINCT conversation_id FROM pm)": _sides("CONVERSATION", _C, 4, 5, 6) | {f"CONVERSATION_{m.upper()}_DIFFERS": f"{_C} = {i}" for i, m in enumerate(rd.CONVERSATION)},
}

_UP = """r AS (SELECT event_id AS i, (user_id // 2)::VARCHAR AS chat, CASE WHEN event_id % 211 = 0 THEN 0 ELSE 1 END::BIGINT AS staged, CASE WHEN event_id % 223 = 0 THEN 0 WHEN event_id % 227 = 0 THEN 2 ELSE 1 END::BIGINT AS stored FROM events), b AS (SELECT * FROM r WHERE staged = 1 AND stored = 1)"""
_CHILD = "SELECT 'k' || i AS source_record_key, '{0}' AS kind, '{1}' || {2} AS child, '{3}' AS code, {4}::BIGINT AS staged, {5}::BIGINT AS stored FROM b WHERE {6}"
_DONE = "d AS (SELECT membership_id AS m FROM membership WHERE membership_id % 37 <> 0 UNION ALL SELECT membership_id FROM membership WHERE membership_id % 41 = 1 UNION ALL SELECT -5)"
_TOPIC = """ek AS (SELECT *, conversation_id % 11 AS c, n || ':' || phrase AS k FROM ev), tq AS (SELECT conversation_id, c, k, count(*) AS m FROM ek GROUP BY 1, 2, 3), mq AS (SELECT conversation_id, conversation_id % 11 AS c, n || ':' || phrase AS k, count(*) AS m FROM mk GROUP BY 1, 2, 3),
mc AS (SELECT DISTINCT conversation_id, c FROM mq), ec AS (SELECT DISTINCT conversation_id, c FROM tq)"""
_EACH = "SELECT conversation_id, '{0}' AS code, count(*) AS n FROM {1} WHERE {2} GROUP BY 1"
_TOPIC_CODES = [
    ("TOPIC_EVIDENCE_ID_EXTRA", "tq", "c = 1"), ("TOPIC_EVIDENCE_ID_MISSING", "tq", "c = 2"), ("TOPIC_EVIDENCE_ID_REPEATED", "tq", "c = 3"), ("TOPIC_EVIDENCE_ID_REPEATED", "ek", "c = 4"), ("TOPIC_EVIDENCE_REPEATED", "ek", "c = 4"), ("PERIOD_ACCOUNT_EVIDENCE_ROW_COUNT_DIFFERS", "ec", "c = 4"),
    ("PERIOD_ACCOUNT_DATED_EVIDENCE_ROW_COUNT_DIFFERS", "ec", "c = 4"), ("MARKER_ACCOUNT_TOPIC_EVIDENCE_ROW_COUNT_DIFFERS", "mc", "c = 4"), ("PERIOD_ACCOUNT_TOPIC_COUNT_DIFFERS", "ec", "c = 5"), ("TOPIC_PERIOD_ORPHAN", "ec", "c = 6"), ("MARKER_ACCOUNT_MISSING", "mc", "c = 7"),
    ("MARKER_HITS_INVALID", "(SELECT *, conversation_id % 11 AS c FROM mk)", "c = 8"), ("MARKER_ACCOUNT_RECONCILIATION_OK_DIFFERS", "mc", "c = 9"), ("MARKER_WITHOUT_EVIDENCE", "mq", "c = 10"), ("MARKER_EVIDENCE_REPEATED", "mq", "c = 10 AND m > 1"),
]
_PEOPLE = f"""WITH {ad.sql_processed(ad.SQL_SPARSE, ad.EVENTS)}, u AS (SELECT DISTINCT user_id AS p FROM events), own AS (SELECT min(p) AS o, count(*) AS k FROM u WHERE p % 50 = 0), w AS (SELECT p, CASE WHEN p % 50 = 0 THEN o ELSE p END AS r FROM u, own),
g AS (SELECT DISTINCT r FROM w), al AS (SELECT p * 2 + x AS a FROM u, (VALUES (0), (1)) v(x)), nb AS (SELECT p, r, lead(p) OVER n AS q, lead(r) OVER n AS rq FROM w WINDOW n AS (PARTITION BY p % 40 ORDER BY p)), cd AS (SELECT * FROM nb WHERE r <> rq),
ms AS (SELECT membership_id AS m, conversation_id * 1000000000 + run_no AS s FROM st WHERE sender_id IS NOT NULL), ru AS (SELECT DISTINCT s FROM ms)"""
_SIDECARS = {
    "w": _sides("MEMBER", "p % 17", 1, 3, -1) | {"MEMBER_PERSON_DIFFERS": "p % 17 = 2"},
    "g": _sides("PERSON", "r % 17", 4, -1, 8) | {"PERSON_OWNER_DIFFERS": "r % 17 = 5", "PERSON_NAME_DIFFERS": "r % 17 = 6", "PERSON_METHOD_DIFFERS": "r % 17 = 7"},
    "al": _sides("ALIAS", "a % 19", 1, -1, -1) | {"ALIAS_PROVENANCE_DIFFERS": "a % 19 IN (2, 3)"},
    "cd": _sides("CANDIDATE", "p % 7", 1, -1, 3) | {"CANDIDATE_BASIS_DIFFERS": "p % 7 = 2"},
    "ms": _sides("SENDER", "m % 23", 1, -1, -1) | {"SENDER_PERSON_DIFFERS": "m % 23 = 2"},
    "ru": _sides("RUN", "s % 29", 1, -1, -1) | {"RUN_PERSON_DIFFERS": "s % 29 = 2", "RUN_CROSSES_PEOPLE": "false"},
}


def _all_counts(tables: dict[str, dict[str, str]]) -> str:
    return f"SELECT c.code AS code, c.n AS n, {SEVERITY.replace('n >', 'c.n >')} FROM (" + " UNION ALL ".join(_counts(table, cases) for table, cases in tables.items()) + ")"


_RUNS = f"""WITH sil AS ({core.ORACLES['silence_events']}), con AS ({core.ORACLES['conflict_candidates']}), rs AS ({core.ORACLES['response_samples']}), cs AS ({core.ORACLES['conversation_summary']}), a(run) AS (VALUES (1::BIGINT), (2)),
ri AS (SELECT conversation_id, count(*) FILTER (WHERE turn_no % 11 = 0) AS x FROM rs GROUP BY 1), si AS (SELECT conversation_id, count(*) FILTER (WHERE conversation_id % 6 = 0 OR conversation_id % 4 = 0) AS x FROM sil GROUP BY 1), ei AS (SELECT conversation_id, count(*) FILTER (WHERE conversation_id % 2 = 1 AND conversation_id % 5 = 1) AS x FROM con GROUP BY 1),
b AS (SELECT run, cs.conversation_id, message_count + CASE WHEN cs.conversation_id % 7 = 1 THEN 1 ELSE 0 END AS src, message_count AS done, message_count - unknown_sender_count - CASE WHEN cs.conversation_id % 7 = 2 THEN 1 ELSE 0 END AS kn, unknown_sender_count AS un, CASE WHEN run = 2 THEN coalesce(ri.x, 0) ELSE 0 END AS r, coalesce(si.x, 0) AS s, coalesce(ei.x, 0) AS e
  FROM cs CROSS JOIN a LEFT JOIN ri ON ri.conversation_id = cs.conversation_id LEFT JOIN si ON si.conversation_id = cs.conversation_id LEFT JOIN ei ON ei.conversation_id = cs.conversation_id)"""
_SNAP = """, ms AS (SELECT conversation_id AS x, turn_no AS k, message_id AS i FROM t1), tt AS (SELECT conversation_id AS x, turn_no AS k FROM turns), cx AS (SELECT DISTINCT conversation_id AS x FROM pm)"""
_OF_CONTEXT = "SELECT x AS context_id, NULL::VARCHAR AS path, '{0}' AS code, count(*) AS n FROM {1} WHERE {2} GROUP BY 1"
_OF_PATH = "SELECT x AS context_id, 'turn/' || k AS path, '{0}' AS code, count(*) AS n FROM {1} WHERE {2} GROUP BY 1, 2"
_SNAP_CODES = [_OF_CONTEXT.format(*c) for c in (
    ("CONTEXT_MISSING_EVIDENCE", "cx", "x % 13 = 1"), ("CONTEXT_OMISSION_COUNT_DIFFERS", "cx", "x % 13 = 3"), ("CONTEXT_OMISSION_HASH_MISSING", "cx", "x % 13 = 4"), ("CONTEXT_OMISSION_NOT_DISCLOSED", "cx", "x % 13 = 5"), ("CONTEXT_MESSAGE_REPEATED", "ms", "i % 59 = 1"),
)] + [_OF_PATH.format(*c) for c in (
    ("MESSAGE_SNAPSHOT_DIFFERS_FROM_LIST", "ms", "i % 41 = 1 OR i % 43 = 1"), ("MESSAGE_OUTSIDE_CONTEXT", "ms", "i % 41 <> 1 AND i % 43 = 1"), ("MESSAGE_PROVENANCE_DIFFERS", "ms", "i % 41 <> 1 AND i % 43 <> 1 AND (i % 47 = 1 OR (i % 53 = 1 AND i % 5 <> 0))"), ("SOURCE_RECORD_DROPPED", "ms", "i % 41 <> 1 AND i % 43 <> 1 AND i % 53 = 1 AND i % 5 <> 0"),
    ("METRIC_OUTSIDE_CONTEXT", "tt", "k % 17 = 1"), ("METRIC_VALUE_DIFFERS", "tt", "k % 17 <> 1 AND k % 19 = 1"), ("METRIC_PROVENANCE_DIFFERS", "tt", "k % 17 <> 1 AND k % 23 = 1"),
)] + ["SELECT x AS context_id, 'nothing' AS path, 'EVIDENCE_EMPTY' AS code, count(*) AS n FROM cx GROUP BY 1"]

QUERIES = {f.__name__: f for f in (analytics_audit, vertical_children, processing_audit, topic_audit, resolution_sidecars, run_reconciliation, snapshot_audit)}
ORACLES = {
    "analytics_audit": f"{core._BASE}, {core._SUMMARY} " + _all_counts(_ANALYTICS),
    "vertical_children": f"WITH {_UP} SELECT 'k' || i AS source_record_key, 'record' AS kind, NULL::VARCHAR AS child, CASE WHEN stored = 0 THEN 'RECORD_MISSING' WHEN staged = 0 THEN 'RECORD_UNEXPECTED' ELSE 'RECORD_REPEATED' END AS code, staged, stored FROM r WHERE staged <> stored UNION ALL "
    + " UNION ALL ".join(_CHILD.format(*x) for x in (("attachment", "a", "i", "CHILD_LOST", 1, 0, "i % 30 = 0"), ("attachment", "z", "i", "CHILD_ADDED", 0, 1, "i % 70 = 0"), ("attachment", "a", "i", "CHILD_REPEATED", 2, 1, "i % 10 = 5 AND i % 15 = 0"), ("conversation", "c", "chat", "CHILD_LOST", 1, 0, "i % 101 = 0"), ("conversation", "d", "chat", "CHILD_ADDED", 0, 1, "i % 101 = 0"))),
    "processing_audit": f"""{store._WITH}, {_DONE}, t AS (SELECT l.membership_id AS m FROM source_membership l JOIN message_source s ON s.message_source_id = l.message_source_id)
      SELECT 'MEMBERSHIP_NOT_PROCESSED' AS code, membership_id FROM membership WHERE membership_id NOT IN (SELECT m FROM d) UNION ALL SELECT 'PROCESSED_WITHOUT_MEMBERSHIP', -5 UNION ALL SELECT 'PROCESSED_TWICE', m FROM d GROUP BY m HAVING count(*) > 1
      UNION ALL SELECT DISTINCT 'PROVENANCE_MISSING', m FROM d WHERE m NOT IN (SELECT m FROM t) UNION ALL SELECT 'INPUT_MEMBERSHIP_COUNT_DIFFERS', NULL""",
    "topic_audit": f"{lexical._BASE}, {_TOPIC} " + " UNION ALL ".join(_EACH.format(*x) for x in _TOPIC_CODES),
    "resolution_sidecars": f"{_PEOPLE} " + _all_counts(_SIDECARS),
    "run_reconciliation": f"""{_RUNS} SELECT run AS analytics_run_id, conversation_id, run AS processing_run_id, 2::BIGINT AS latest_processing_run_id, src AS a4_source_membership_count, done AS a3_processed_membership_count, src - done AS membership_count_delta, kn AS known_sender_message_count, un AS unknown_sender_message_count,
      kn + un AS sender_accounted_membership_count, r AS invalid_response_session_count, s AS invalid_silence_session_count, e AS invalid_event_session_count, CASE WHEN run = 2 THEN 1 ELSE 0 END::BIGINT AS uses_latest_processing_run, CASE WHEN run = 2 AND src = done AND src = kn + un AND r = 0 AND s = 0 AND e = 0 THEN 1 ELSE 0 END::BIGINT AS reconciliation_ok FROM b""",
    "snapshot_audit": f"{core._BASE}{_SNAP} " + " UNION ALL ".join(_SNAP_CODES),
}
