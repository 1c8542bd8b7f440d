"""Views over canonical and derived tables, latest runs, integrity audits. Inputs are DataFrames by name, nothing is collected."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def analysis_messages(memberships: DataFrame, messages: DataFrame, participants: DataFrame) -> DataFrame:
    """A row for each membership with its message and, if known, its sender."""
    p = participants.select(F.col("participant_id").alias("sender_id"), F.col("canonical_name").alias("sender_name"), F.col("is_self").alias("sender_is_self"))
    return memberships.join(messages, "message_id").join(p, "sender_id", "left")


def analysis_conversations(conversations: DataFrame, memberships: DataFrame, messages: DataFrame, members: DataFrame) -> DataFrame:
    """All conversations, empty ones too; messages and members are counted apart, so that neither multiplies the other."""
    a = memberships.join(messages.select("message_id", "timestamp_us"), "message_id").groupBy("conversation_id").agg(F.count_distinct("message_id").alias("message_count"), F.min("timestamp_us").alias("first_us"), F.max("timestamp_us").alias("last_us"))
    b = members.groupBy("conversation_id").agg(F.count_distinct("participant_id").alias("participant_count"))
    return conversations.join(a, "conversation_id", "left").join(b, "conversation_id", "left").fillna(0, ["message_count", "participant_count"])


def latest_run(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """Rows of the last completed run."""
    last = runs.where("status = 'completed'").agg(F.max("run_id").alias("run_id"))
    return rows.join(F.broadcast(last), "run_id")


def latest_run_per_conversation(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """Rows of each conversation's last completed run."""
    done = rows.select("conversation_id", "run_id").distinct().join(runs.where("status = 'completed'").select("run_id"), "run_id")
    return rows.join(done.groupBy("conversation_id").agg(F.max("run_id").alias("run_id")), ["conversation_id", "run_id"])


def identity_audit(rows: DataFrame) -> DataFrame:
    """Memberships, or messages of a conversation, that come more than once."""
    a = rows.groupBy("membership_id").count().where("count > 1").select(F.lit("membership").alias("kind"), F.col("membership_id").cast("string").alias("key"), "count")
    b = rows.groupBy("conversation_id", "message_id").count().where("count > 1").select(F.lit("conversation_message").alias("kind"), F.concat_ws("/", "conversation_id", "message_id").alias("key"), "count")
    return a.unionByName(b)


def orphans(child: DataFrame, parent: DataFrame, on: dict[str, str], code: str) -> DataFrame:
    """An issue with the number of child rows whose columns (keys of `on`) name no parent row (values of `on`)."""
    p = parent.select(*[F.col(v).alias(f"_{k}") for k, v in on.items()]).distinct()
    condition = reduce(lambda x, y: x & y, [F.col(k) == F.col(f"_{k}") for k in on])
    known = reduce(lambda x, y: x & y, [F.col(k).isNotNull() for k in on])
    return child.where(known).join(p, condition, "left_anti").agg(F.count("*").alias("n")).select(F.lit(code).alias("code"), "n")


def primary_audit(memberships: DataFrame) -> DataFrame:
    """Messages that don't have exactly one primary membership."""
    return memberships.groupBy("message_id").agg(F.count_if("is_primary").alias("primaries")).where("primaries <> 1")


def issues(*checks: DataFrame) -> DataFrame:
    """Checks (code, n) in one table with their severity, and errors first."""
    return reduce(DataFrame.unionByName, checks).select("code", "n", F.when(F.col("n") > 0, "ERROR").otherwise("OK").alias("severity"))


def verdict(rows: DataFrame) -> DataFrame:
    """FAIL if any row is an ERROR, WARNING if any is that, else PASS."""
    worst = F.max(F.when(F.col("severity") == "ERROR", 2).when(F.col("severity") == "WARNING", 1).otherwise(0))
    return rows.agg(F.when(worst == 2, "FAIL").when(worst == 1, "WARNING").otherwise("PASS").alias("verdict"))


def multiset_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that one side has more often than the other, each as often as that."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def evidence_audit(derived: DataFrame, messages: DataFrame, ids: str = "source_message_ids") -> DataFrame:
    """Ids of evidence that are no message of the conversation."""
    named = derived.select("conversation_id", F.explode(ids).alias("message_id"))
    return named.join(messages.select("conversation_id", "message_id").distinct(), ["conversation_id", "message_id"], "left_anti")


def reconciliation(summary: DataFrame, processed: DataFrame) -> DataFrame:
    """Whether participants' messages and those of unknown senders add up to the memberships of each conversation."""
    known = summary.groupBy("conversation_id").agg(F.sum("message_count").alias("known"))
    whole = processed.groupBy("conversation_id").agg(F.count("*").alias("memberships"), F.count_if(F.col("sender_id").isNull()).alias("unknown"))
    joined = whole.join(known, "conversation_id", "left").fillna(0, ["known"])
    return joined.withColumn("delta", F.col("memberships") - F.col("known") - F.col("unknown")).withColumn("ok", F.col("delta") == 0)


def fingerprints(messages: DataFrame, columns: list[str]) -> DataFrame:
    """A digest of each conversation's rows, whatever their order: any change changes it."""
    wide = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    # Sums over parts of the rows' digests combine map-side; a conversation is never gathered.
    part = lambda i: F.sum(F.conv(F.substring(wide, 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)"))
    return messages.groupBy("conversation_id").agg(F.sha2(F.concat_ws(":", F.count("*"), *[part(i) for i in range(5)]), 256).alias("fingerprint"))


def changed_conversations(current: DataFrame, state: DataFrame) -> DataFrame:
    """Conversations whose fingerprint, signature or run isn't that of the state."""
    return current.join(state, ["conversation_id", "fingerprint", "signature", "run_id"], "left_anti")


def resolved_senders(messages: DataFrame, sidecar: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Messages with resolved senders, and the memberships that the sidecar lacks, has alone, or gives a sender where there is none or none where there is one."""
    s = sidecar.select("membership_id", F.col("resolved_id").alias("_resolved"), F.lit(True).alias("_there"))
    joined = messages.withColumn("_here", F.lit(True)).join(s, "membership_id", "full")
    bad = joined.where(F.col("_here").isNull() | F.col("_there").isNull() | (F.col("sender_id").isNull() != F.col("_resolved").isNull())).select("membership_id")
    return joined.where("_here AND _there").withColumn("sender_id", F.col("_resolved")).drop("_here", "_there", "_resolved"), bad




def analysis_attachments(occurrences: DataFrame, attachments: DataFrame) -> DataFrame:
    """A row for each occurrence with its blob."""
    return occurrences.join(attachments, "attachment_id").select("occurrence_id", "message_id", "attachment_id", "sha256", "mime_type", "position")


def _runs(runs: DataFrame, *more: str) -> DataFrame:
    """import_run_id, the snapshot's key and what more is asked for."""
    return runs.select("import_run_id", F.coalesce("source_sha256", F.concat(F.lit("fingerprint:"), "source_fingerprint")).alias("source_snapshot_key"), "source_sha256", *more)


def analysis_message_sources(sources: DataFrame, runs: DataFrame) -> DataFrame:
    """Every source of a message with the snapshot it came from."""
    return sources.join(_runs(runs), "import_run_id").select("message_id", "source_type", "source_snapshot_key", "source_sha256", "source_conversation_id", "source_record_key", "import_run_id")


def analysis_memberships(memberships: DataFrame, links: DataFrame, conversation_sources: DataFrame) -> DataFrame:
    """Every membership with the source conversations behind it, if any."""
    c = conversation_sources.select("conversation_source_id", "source_type", "source_sha256", "source_conversation_id")
    joined = memberships.select("membership_id", "message_id", "conversation_id", "is_primary").join(links, "membership_id", "left").join(c, "conversation_source_id", "left")
    return joined.select("membership_id", "message_id", "conversation_id", "is_primary", "message_source_id", "conversation_source_id", "source_type", "source_sha256", "source_conversation_id", "position")


def analysis_attachment_sources(attachment_sources: DataFrame, runs: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Every source of an attachment with its snapshot, and with its occurrence if it has one."""
    o = occurrences.select("occurrence_id", "message_id", "position")
    joined = attachment_sources.join(_runs(runs, "source_type", "parser_version"), "import_run_id").join(o, "occurrence_id", "left")
    return joined.select("attachment_source_id", "attachment_id", "occurrence_id", "message_id", "position", "import_run_id", "source_type", "source_snapshot_key", "parser_version", "source_occurrence_key")


def resolved_latest(rows: DataFrame, sidecar: DataFrame, runs: DataFrame, on: str = "membership_id") -> DataFrame:
    """Rows of the last completed run with what the sidecar resolved of them in that run; null where it has nothing."""
    return latest_run(rows, runs).join(sidecar, ["run_id", on], "left")


def message_provenance(messages: DataFrame, relations: DataFrame, attachments: DataFrame, sources: DataFrame, runs: DataFrame) -> DataFrame:
    """Each message with its first reply target (by relation id, then target), and the distinct kinds of its attachments, keys,
    snapshots and parsers."""
    order = F.when(F.col("relation_id").isNotNull(), F.struct("relation_id", "target_message_id"))
    reply = relations.where(F.lower("relation_type").contains("reply")).groupBy(F.col("source_message_id").alias("message_id")).agg(F.min_by("target_message_id", order).alias("reply_to"))
    kinds = attachments.where("mime_type IS NOT NULL").groupBy("message_id").agg(F.sort_array(F.collect_set("mime_type")).alias("mime_types"))
    per = sources.join(_runs(runs, "parser_version"), "import_run_id").groupBy("message_id").agg(*[F.sort_array(F.collect_set(c)).alias(f"{c}s") for c in ("source_record_key", "source_snapshot_key", "parser_version")])
    return messages.select("message_id").join(reply, "message_id", "left").join(kinds, "message_id", "left").join(per, "message_id", "left")


def labelled(rows: DataFrame, participants: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Adds <column>_name for each column of participants' ids; ids without a name stay with a null."""
    for c in columns:
        p = participants.select(F.col("participant_id").alias(f"_{c}"), F.col("canonical_name").alias(f"{c}_name"))
        rows = rows.join(p, F.col(c) == F.col(f"_{c}"), "left").drop(f"_{c}")
    return rows


def analytic_read(memberships: DataFrame, processed: DataFrame) -> DataFrame:
    """Memberships with what was processed of them, by membership, message and conversation. A task that meets one of these
    twice on either side fails: which of them is meant is not guessed."""
    keys = ["membership_id", "message_id", "conversation_id"]
    once = F.count("*").over(Window.partitionBy(*keys)) == 1
    checked = lambda rows, side: rows.withColumn("_ok", once).where(F.assert_true("_ok", F.concat(F.lit(f"{side} twice: membership "), F.col("membership_id").cast("string"))).isNull()).drop("_ok")
    return checked(memberships, "membership").join(checked(processed, "processed"), keys)


def resolve_evidence(messages: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The messages that are wanted (conversation_id, message_id), and what is wanted but no message."""
    keys = ["conversation_id", "message_id"]
    return messages.join(wanted.select(*keys), keys, "left_semi"), wanted.select(*keys).distinct().join(messages.select(*keys), keys, "left_anti")


def run_reconciliation(conversations: DataFrame, runs: DataFrame, processing: DataFrame, processed: DataFrame, sessions: DataFrame, responses: DataFrame, silences: DataFrame, events: DataFrame) -> DataFrame:
    """Each conversation of each analytics run against the latest completed processing run, with all counts and whether they agree.

    conversations: analytics_run_id, conversation_id, source_message_count, known_sender_message_count,
    unknown_sender_message_count; runs: analytics_run_id, processing_run_id; processing: processing_run_id, status; processed:
    processing_run_id, conversation_id; sessions: processing_run_id, conversation_id, session_id; responses, silences and
    events: analytics_run_id, conversation_id and session_id, or previous_session_id and next_session_id. A session must be one
    of the run's own processing run and conversation; an event may have none. No rows come if no processing run is completed.
    """
    latest = processing.where("status = 'completed'").agg(F.max("processing_run_id").alias("latest_processing_run_id")).where("latest_processing_run_id IS NOT NULL")
    counted = processed.join(latest, F.col("processing_run_id") == F.col("latest_processing_run_id")).groupBy("conversation_id").agg(F.count("*").alias("_processed"))
    at = ["analytics_run_id", "conversation_id"]
    of = sessions.select("processing_run_id", "conversation_id", "session_id").distinct()

    def invalid(rows: DataFrame, columns: tuple[str, ...], name: str) -> DataFrame:
        """How many rows of a run's conversation name a session, in any of the columns, that isn't there."""
        known = rows.select(*at, *columns).join(runs.select("analytics_run_id", "processing_run_id"), "analytics_run_id")
        for c in columns:
            known = known.join(of.withColumnRenamed("session_id", c).withColumn(f"_{c}", F.lit(True)), ["processing_run_id", "conversation_id", c], "left")
        missing = reduce(lambda x, y: x | y, [F.col(f"_{c}").isNull() for c in columns])
        return known.groupBy(*at).agg(F.count_if(missing).alias(name))

    parts = {
        "invalid_response_session_count": invalid(responses, ("session_id",), "invalid_response_session_count"),
        "invalid_silence_session_count": invalid(silences, ("previous_session_id", "next_session_id"), "invalid_silence_session_count"),
        "invalid_event_session_count": invalid(events.where("session_id IS NOT NULL"), ("session_id",), "invalid_event_session_count"),
    }
    rows = conversations.join(runs.select("analytics_run_id", "processing_run_id"), "analytics_run_id").join(latest, F.lit(True)).join(counted, "conversation_id", "left")
    rows = reduce(lambda x, y: x.join(y, at, "left"), parts.values(), rows).fillna(0, ["_processed", *parts])
    source, told = F.col("source_message_count"), F.col("known_sender_message_count") + F.col("unknown_sender_message_count")
    newest = F.col("processing_run_id") == F.col("latest_processing_run_id")
    ok = reduce(lambda x, y: x & y, [F.col(c) == 0 for c in parts], newest & (source == F.col("_processed")) & (source == told))
    return rows.select(
        *at, "processing_run_id", "latest_processing_run_id", source.alias("a4_source_membership_count"), F.col("_processed").alias("a3_processed_membership_count"), (source - F.col("_processed")).alias("membership_count_delta"),
        "known_sender_message_count", "unknown_sender_message_count", told.alias("sender_accounted_membership_count"), *parts, F.when(newest, 1).otherwise(0).cast("bigint").alias("uses_latest_processing_run"), F.when(ok, 1).otherwise(0).cast("bigint").alias("reconciliation_ok"),
    )
