"""Audits of the canonical store, of staged records and of what is derived from them. Each check counts rows at fault and is
a row (code, n) of one table; nothing is repaired, and every check is an anti join, a join with a residual, or an aggregate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import views as vw

#: Tables of the canonical store, by name.
Store = dict[str, DataFrame]


def _n(rows: DataFrame, code: str) -> DataFrame:
    return rows.agg(F.count("*").alias("n")).select(F.lit(code).alias("code"), "n")


def _without(rows: DataFrame, other: DataFrame, on: str, code: str) -> DataFrame:
    return _n(rows.join(other.select(on).where(F.col(on).isNotNull()).distinct(), on, "left_anti"), code)


def _differ(actual: Column, rows: DataFrame, expected: Column, against: DataFrame, code: str) -> DataFrame:
    """1 if the two counts are not equal, else 0."""
    return rows.agg(actual.alias("a")).crossJoin(against.agg(expected.alias("b"))).select(F.lit(code).alias("code"), F.when(F.col("a") == F.col("b"), 0).otherwise(1).cast("bigint").alias("n"))


def structure(s: Store) -> list[DataFrame]:
    """That source relations, memberships and attachments speak of the same messages and conversations."""
    m, mc, ms, msc, cs, ir = (s[k] for k in ("message", "membership", "message_source", "source_membership", "conversation_source", "import_run"))
    a, o, ma, ats = (s[k] for k in ("attachment", "occurrence", "message_attachment", "attachment_source"))
    primary = mc.where("is_primary").groupBy("message_id").agg(F.count("*").alias("primaries"))
    pointed = mc.where("is_primary").select("message_id", "conversation_id").distinct()
    named = ms.where("source_conversation_id IS NOT NULL")
    link = msc.join(ms.select("message_source_id", F.col("message_id").alias("_source")), "message_source_id").join(mc.select("membership_id", F.col("message_id").alias("_member"), F.col("conversation_id").alias("_conversation")), "membership_id")
    run = ir.select("import_run_id", F.col("source_type").alias("_type"), F.col("source_sha256").alias("_sha"))
    return [
        _without(m, ms, "message_id", "MESSAGE_SOURCE_TRACE_MISSING"),
        _without(m, mc, "message_id", "MESSAGE_CONVERSATION_MEMBERSHIP_MISSING"),
        _n(m.join(primary, "message_id", "left").where("coalesce(primaries, 0) <> 1"), "MESSAGE_PRIMARY_MEMBERSHIP_COUNT_INVALID"),
        _n(m.join(pointed, ["message_id", "conversation_id"], "left_anti"), "MESSAGE_PRIMARY_POINTER_MISMATCH"),
        _without(named, msc, "message_source_id", "MESSAGE_SOURCE_CONVERSATION_TRACE_MISSING"),
        _n(link.where("_source <> _member"), "MESSAGE_SOURCE_MEMBERSHIP_MESSAGE_MISMATCH"),
        _n(link.join(cs.select("conversation_source_id", "conversation_id"), "conversation_source_id").where("conversation_id <> _conversation"), "SOURCE_MEMBERSHIP_CONVERSATION_MISMATCH"),
        _n(ms.join(run, "import_run_id").where("source_type <> _type"), "MESSAGE_SOURCE_IMPORT_TYPE_MISMATCH"),
        _n(cs.join(run, "import_run_id").where("source_type <> _type"), "CONVERSATION_SOURCE_IMPORT_TYPE_MISMATCH"),
        _n(cs.join(run, "import_run_id").where("source_sha256 <> _sha"), "CONVERSATION_SOURCE_SHA_MISMATCH"),
        _without(a, ats, "attachment_id", "ATTACHMENT_SOURCE_TRACE_MISSING"),
        _n(o.join(ma.select("message_id", "attachment_id").distinct(), ["message_id", "attachment_id"], "left_anti"), "ATTACHMENT_OCCURRENCE_BLOB_MAPPING_MISSING"),
        _without(o, ats, "occurrence_id", "ATTACHMENT_OCCURRENCE_SOURCE_TRACE_MISSING"),
        _n(ats.join(o.select("occurrence_id", F.col("attachment_id").alias("_blob")), "occurrence_id").where("attachment_id <> _blob"), "ATTACHMENT_SOURCE_OCCURRENCE_MISMATCH"),
        _n(ats.where("source_occurrence_key IS NOT NULL AND occurrence_id IS NULL"), "ATTACHMENT_SOURCE_OCCURRENCE_LINK_MISSING"),
    ]


def coverage(s: Store) -> list[DataFrame]:
    """That every view has as many rows, or distinct ids, as the table that it shows."""
    every, ids = F.count("*"), lambda c: F.count_distinct(c)
    messages = s["membership"].join(s["message"].drop("conversation_id"), "message_id")
    conversations = vw.analysis_conversations(s["conversation"], s["membership"], s["message"].select("message_id", F.lit(None).cast("bigint").alias("timestamp_us")), s["membership"].select("conversation_id", F.lit(None).cast("bigint").alias("participant_id")))
    return [
        _differ(every, messages, every, s["membership"], "ANALYSIS_MESSAGES_MEMBERSHIP_COUNT_MISMATCH"),
        _differ(ids("message_id"), messages, every, s["message"], "ANALYSIS_MESSAGES_CANONICAL_COVERAGE_MISMATCH"),
        _differ(every, conversations, every, s["conversation"], "ANALYSIS_CONVERSATIONS_COUNT_MISMATCH"),
        _differ(every, vw.analysis_attachments(s["occurrence"], s["attachment"]), every, s["occurrence"], "ANALYSIS_ATTACHMENTS_OCCURRENCE_COUNT_MISMATCH"),
        _differ(every, vw.analysis_message_sources(s["message_source"], s["import_run"]), every, s["message_source"], "ANALYSIS_MESSAGE_SOURCES_COUNT_MISMATCH"),
        _differ(ids("membership_id"), vw.analysis_memberships(s["membership"], s["source_membership"], s["conversation_source"]), every, s["membership"], "ANALYSIS_MEMBERSHIP_COVERAGE_MISMATCH"),
    ]


def store_report(s: Store) -> DataFrame:
    """All 21 checks of a store (code, n, severity)."""
    return vw.issues(*structure(s), *coverage(s))


def staged_records(records: DataFrame, expected: DataFrame) -> DataFrame:
    """The contract of staged records. records: record_id, source_type, source_sha256, guid, source_message_id,
    source_conversation_id, source_record_key, contract, timestamp_us, timestamp_precision, is_outgoing, sender, refs (an
    array of structs with conversation_key) and attachments (an array of structs with position). expected: messages, errors."""
    from . import canonical as ca

    key = ca.source_record_key(F.col("source_type"), F.col("source_sha256"), F.col("guid"), F.col("source_message_id"), F.col("source_conversation_id"))
    again = records.where("source_record_key IS NOT NULL").groupBy("source_record_key").agg(F.count("*").alias("c")).where("c > 1")
    known = F.col("timestamp_precision").isin("nanosecond", *ca.PRECISIONS)
    refs = records.select("record_id", F.explode("refs").alias("r"))
    positions = records.select("record_id", F.explode("attachments").alias("a")).groupBy("record_id").agg(F.count("*").alias("c"), F.count_distinct("a.position").alias("d"), F.min("a.position").alias("low")).where("c <> d OR low < 0")
    e = expected.select("messages", "errors")
    return vw.issues(
        _n(records.where("contract IS DISTINCT FROM '1'"), "CONTRACT_VERSION_UNSUPPORTED"),
        _n(records.where("source_record_key IS NULL"), "RECORD_KEY_MISSING"),
        _n(records.where(F.col("source_record_key") != key), "RECORD_KEY_MISMATCH"),
        _n(again, "RECORD_KEY_DUPLICATE"),
        _n(records.where("source_sha256 IS NULL OR NOT source_sha256 RLIKE '^[0-9a-f]{64}$'"), "SOURCE_SHA_INVALID"),
        _n(records.where(F.col("timestamp_us").isNotNull() & ~F.coalesce(known, F.lit(False))), "TIMESTAMP_PRECISION_INVALID"),
        _n(records.where("timestamp_us IS NULL AND timestamp_precision IN ('nanosecond', 'microsecond', 'second')"), "TIMESTAMP_MISSING_FOR_PRECISION"),
        _n(records.where("size(refs) = 0 OR refs IS NULL"), "CONVERSATION_RELATION_MISSING"),
        _n(refs.where("r.conversation_key IS NULL OR r.conversation_key = ''"), "CONVERSATION_RELATION_KEY_EMPTY"),
        _n(refs.groupBy("record_id", "r.conversation_key").count().where("count > 1"), "CONVERSATION_RELATION_DUPLICATE"),
        _n(positions, "ATTACHMENT_POSITION_INVALID"),
        _differ(F.count("*"), records, F.max("messages"), e, "MESSAGE_COUNT_MISMATCH"),
        _n(e.where("errors <> 0"), "SOURCE_ERRORS_PRESENT"),
    )


def vertical(staged: DataFrame, s: Store) -> DataFrame:
    """Staged records against the store: keys as multisets both ways, keys without a message, attachments and conversations.
    staged: source_record_key, n_attachments, n_conversations."""
    have = s["message_source"].select("source_record_key")
    keys = staged.select("source_record_key")
    per = s["message_source"].join(s["occurrence"].groupBy("message_id").agg(F.count("*").alias("o")), "message_id", "left").join(s["membership"].groupBy("message_id").agg(F.count("*").alias("m")), "message_id", "left").fillna(0, ["o", "m"])
    joined = staged.join(per.select("source_record_key", "o", "m"), "source_record_key")
    return vw.issues(
        _n(keys.exceptAll(have), "STAGED_RECORD_MISSING"), _n(have.exceptAll(keys), "UNSTAGED_RECORD_PRESENT"),
        _n(s["message_source"].join(s["message"].select("message_id"), "message_id", "left_anti"), "SOURCE_WITHOUT_MESSAGE"),
        _n(joined.where("n_attachments > o"), "ATTACHMENTS_LOST"), _n(joined.where("n_conversations > m"), "MEMBERSHIPS_LOST"),
    )


def store_fingerprint(s: Store) -> DataFrame:
    """For each table its rows and a digest that any change of a row changes, whatever their order."""
    parts = []
    for name in sorted(s):
        row = F.sha2(F.to_json(F.struct(*sorted(s[name].columns)), {"ignoreNullFields": "false"}), 256)
        sums = [F.coalesce(F.sum(F.conv(F.substring(row, 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")), F.lit(0)) for i in range(5)]
        parts.append(s[name].agg(F.count("*").alias("n"), F.sha2(F.concat_ws(":", F.count("*"), *sums), 256).alias("fingerprint")).select(F.lit(name).alias("table_name"), "n", "fingerprint"))
    return reduce(DataFrame.unionByName, parts)


def resolution_oracle(participants: DataFrame, resolved: DataFrame) -> DataFrame:
    """That all explicit owners and nobody else became the smallest of them. resolved: participant_id, resolved_id."""
    own = participants.where("is_self").agg(F.min("participant_id").alias("_self"))
    want = participants.crossJoin(F.broadcast(own)).select("participant_id", F.when(F.coalesce("is_self", F.lit(False)), F.col("_self")).otherwise(F.col("participant_id")).alias("_want"))
    both = want.join(resolved.select("participant_id", "resolved_id"), "participant_id", "full")
    return vw.issues(
        _n(both.where("_want IS NOT NULL AND resolved_id IS NULL"), "RESOLUTION_MISSING"), _n(both.where("_want IS NULL"), "RESOLUTION_UNKNOWN_PARTICIPANT"), _n(both.where("_want <> resolved_id"), "RESOLUTION_DIFFERS"),
    )


def evidence_drift(evidence: DataFrame, messages: DataFrame) -> DataFrame:
    """Snapshots of messages (evidence: message_id, text_sha256, timestamp_us) against what the messages are now: PASS,
    STALE (text or time differ), FAIL (no such message), UNVERIFIED (the snapshot holds no digest)."""
    now = messages.select("message_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("_sha"), F.col("timestamp_us").alias("_us"), F.lit(True).alias("_there"))
    status = F.when(F.col("_there").isNull(), "FAIL").when(F.col("text_sha256").isNull(), "UNVERIFIED").when((F.col("text_sha256") != F.col("_sha")) | ~F.col("timestamp_us").eqNullSafe(F.col("_us")), "STALE").otherwise("PASS")
    return evidence.join(now, "message_id", "left").select("message_id", status.alias("status"))


def session_provenance(derived: DataFrame, sessions: DataFrame) -> DataFrame:
    """Rows that name a session (conversation_id, session_no) which the run doesn't have."""
    return derived.join(sessions.select("conversation_id", "session_no").distinct(), ["conversation_id", "session_no"], "left_anti")


def conflict_ids_in_session(conflicts: DataFrame, sessions_of: DataFrame) -> DataFrame:
    """Ids of evidence that lie outside the session of their conflict. sessions_of: conversation_id, message_id, session_no."""
    named = conflicts.select("conversation_id", F.col("session_no").alias("_session"), F.explode("source_message_ids").alias("message_id"))
    return named.join(sessions_of, ["conversation_id", "message_id"], "left").where("session_no IS DISTINCT FROM _session").select("conversation_id", "message_id", F.col("_session").alias("session_no"))


def context_warnings(messages: DataFrame, sources: DataFrame) -> DataFrame:
    """Messages of unknown time, and messages without a source."""
    return vw.issues(_n(messages.where("timestamp_us IS NULL"), "UNKNOWN_TIMESTAMPS"), _without(messages, sources, "message_id", "PROVENANCE_MISSING"))


def release_verdict(reports: DataFrame) -> DataFrame:
    """reports: name, status, sha. Ready if all are VALID and speak of one SHA."""
    good = (F.count("*") > 0) & (F.count_if(~(F.coalesce(F.col("status"), F.lit("")) == "VALID")) == 0) & (F.count_distinct("sha") == 1) & (F.count_if(F.col("sha").isNull()) == 0)
    return reports.agg(F.when(good, "READY").otherwise("BLOCKED").alias("verdict"), F.count("*").alias("reports"), F.count_if(F.col("status") == "VALID").alias("valid"))


def id_arrays(rows: DataFrame, column: str) -> DataFrame:
    """A JSON array of ids (string) to ids, and ok: it is an array of whole numbers without repeats."""
    ids = F.from_json(F.col(column), "array<bigint>")
    ok = F.col(column).rlike(r"^\s*\[\s*(-?\d+\s*(,\s*-?\d+\s*)*)?\]\s*$") & (F.size(ids) == F.size(F.array_distinct(ids)))
    return rows.select("*", F.when(F.coalesce(ok, F.lit(False)), ids).alias("ids"), F.coalesce(ok, F.lit(False)).alias("ok"))


def exact_targets(labels: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted: label. labels: conversation_id, label (a title, key, name or identity). For each wanted label, equal but for case
    and white space, its conversation if there is exactly one, else a null, and how many there are."""
    plain = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    have = labels.select(plain("label").alias("_label"), "conversation_id").distinct()
    joined = wanted.withColumn("_label", plain("label")).join(have, "_label", "left").groupBy("label").agg(F.count_distinct("conversation_id").alias("found"), F.min("conversation_id").alias("_id"))
    return joined.select("label", "found", F.when(F.col("found") == 1, F.col("_id")).alias("conversation_id"))


def last_messages(messages: DataFrame, n: int) -> DataFrame:
    """The newest n messages of each conversation."""
    w = Window.partitionBy("conversation_id").orderBy(F.col("timestamp_us").desc_nulls_last(), F.col("membership_id").desc())
    return messages.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")
