"""Packets of messages for a reader: what is chosen with what stands around it, where it comes from, and audits of both.

A packet is a packet_id with its rows; all functions take any number of packets at once. Faults are rows (packet_id, code, n):
nothing is dropped or repaired on the way.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What a kind of candidate claims, by its type; any other type claims `candidate`.
SEMANTICS = {
    "conflict": "pattern_candidate",
    "engagement_signal": "heuristic_signal",
    "dyadic_regime": "pattern_candidate",
    "change_point": "metric_pattern",
    "lexical_topic": "lexical_evidence",
}
# Names of a source conversation, the first has precedence only in the order of the result.
SOURCE_LABELS = ("display_name", "chat_identifier", "guid", "room_name", "group_id", "account_login")


def message_order() -> list[Column]:
    """Unknown times last, then by conversation and membership."""
    return [F.col("timestamp_us").asc_nulls_last(), F.col("conversation_id").asc(), F.col("membership_id").asc()]


def finding_order() -> list[Column]:
    """The newest first, unknown starts last."""
    return [F.col("start_us").desc_nulls_last(), F.col("finding_id").asc()]


def candidate_order() -> list[Column]:
    return [F.col("start_us").asc(), F.col("end_us").asc(), F.col("candidate_type").asc(), F.col("candidate_id").asc()]


def of_conversations(rows: DataFrame, wanted: DataFrame | list) -> DataFrame:
    """Rows of the conversations wanted: a list reaches the scan as a filter, a table (conversation_id) is a semi join."""
    if isinstance(wanted, DataFrame):
        return rows.join(wanted.select("conversation_id").distinct(), "conversation_id", "left_semi")
    return rows.where(F.col("conversation_id").isin(*wanted)) if wanted else rows.where(F.lit(False))


def between(rows: DataFrame, start_us: int | None, end_us: int | None) -> DataFrame:
    """Rows of known time from start to end, both included; an open end is no bound."""
    keep = F.col("timestamp_us").isNotNull()
    if start_us is not None:
        keep &= F.col("timestamp_us") >= start_us
    if end_us is not None:
        keep &= F.col("timestamp_us") <= end_us
    return rows.where(keep)


def contact_labels(conversations: DataFrame) -> DataFrame:
    """conversation_id and contact: the title, else the canonical key, else the id."""
    return conversations.select("conversation_id", F.coalesce("title", "canonical_key", F.col("conversation_id").cast("string")).alias("contact"))


def source_labels(metadata: Column, depth: int = 4) -> Column:
    """A struct of the known names in JSON metadata: each from the outermost object that has it non-empty, `metadata` in `metadata` down to depth."""
    found = lambda key: F.coalesce(*[F.nullif(F.get_json_object(metadata, "$" + ".metadata" * i + f".{key}"), F.lit("")) for i in range(depth)])
    return F.struct(*[found(key).alias(key) for key in SOURCE_LABELS])


def semantics(candidate_type: Column) -> Column:
    plain = F.lower(F.trim(candidate_type))
    return F.coalesce(reduce(lambda so_far, kv: so_far.when(plain == kv[0], kv[1]), list(SEMANTICS.items())[1:], F.when(plain == "conflict", SEMANTICS["conflict"])), F.lit("candidate"))


def candidate_provenance(candidates: DataFrame, runs: DataFrame, states: DataFrame) -> DataFrame:
    """Candidates (analytics_run_id, conversation_id, candidate_type) with the version, processing run, fingerprint and
    signature behind them, what they claim, and a status: complete, run_missing, run_not_completed or state_missing."""
    r = runs.select("analytics_run_id", "analytics_version", "processing_run_id", F.col("status").alias("_status"), F.lit(True).alias("_run"))
    s = states.select("analytics_run_id", "conversation_id", "source_fingerprint", "analysis_signature", F.lit(True).alias("_state"))
    status = F.when(F.col("_run").isNull(), "run_missing").when(~F.col("_status").eqNullSafe(F.lit("completed")), "run_not_completed").when(F.col("_state").isNull(), "state_missing").otherwise("complete")
    joined = candidates.join(r, "analytics_run_id", "left").join(s, ["analytics_run_id", "conversation_id"], "left")
    return joined.withColumns({"provenance_status": status, "candidate_semantics": semantics(F.col("candidate_type"))}).drop("_run", "_status", "_state")


def context_hash(context: list[str], analysis_type: str, mode: str, provider: str, model: str, prompt_version: str) -> Column:
    """SHA-256 of canonical JSON (sorted keys, nothing between) of the columns named and of what they are sent to."""
    told = {"analysis_type": F.lit(analysis_type), "context": F.struct(*sorted(context)), "mode": F.lit(mode), "model": F.lit(model), "prompt_version": F.lit(prompt_version), "provider": F.lit(provider)}
    return F.sha2(F.to_json(F.struct(*[told[k].alias(k) for k in sorted(told)]), {"ignoreNullFields": "false"}), 256)


def ids_hash(ids: Column) -> Column:
    """SHA-256 of a JSON array of ids as strings, in their order; null for no ids."""
    return F.when(F.size(ids) > 0, F.sha2(F.to_json(F.transform(ids, lambda i: i.cast("string"))), 256))


def packet_rows(messages: DataFrame, selected: DataFrame, before: int = 0, after: int = 0) -> DataFrame:
    """Messages selected (packet_id, message_id) and up to before and after of their neighbours in the same conversation;
    each message once for each packet, with selected. Neighbours are found by place: no conversation is gathered."""
    at = Window.partitionBy("conversation_id").orderBy(F.col("timestamp_us").asc_nulls_last(), "membership_id")
    placed = messages.withColumn("_at", F.row_number().over(at).cast("bigint"))
    hits = placed.join(selected.select("packet_id", "message_id").distinct(), "message_id").select("packet_id", "conversation_id", "_at", F.explode(F.sequence(F.lit(-max(0, before)), F.lit(max(0, after)))).alias("_off"))
    wanted = hits.groupBy("packet_id", "conversation_id", (F.col("_at") + F.col("_off")).alias("_at")).agg(F.max(F.col("_off") == 0).alias("selected"))
    return wanted.join(placed, ["conversation_id", "_at"]).select("packet_id", *messages.columns, "selected")


def selection_faults(messages: DataFrame, selected: DataFrame, before: int = 0, after: int = 0) -> DataFrame:
    """Why a selection can't be a packet: ids twice, ids of no message, several conversations, unknown times in it or around it."""
    twice = selected.groupBy("packet_id", "message_id").agg(F.count("*").alias("c")).where("c > 1").groupBy("packet_id").agg(F.count("*").alias("n"))
    lost = selected.distinct().join(messages.select("message_id").distinct(), "message_id", "left_anti").groupBy("packet_id").agg(F.count("*").alias("n"))
    rows = packet_rows(messages, selected, before, after)
    unknown = F.col("timestamp_us").isNull()
    per = rows.groupBy("packet_id").agg(F.count_distinct(F.when(F.col("selected"), F.col("conversation_id"))).alias("c"), F.count_if(unknown & F.col("selected")).alias("s"), F.count_if(unknown & ~F.col("selected")).alias("u"))
    named = [("SELECTED_ID_DUPLICATE", twice), ("SELECTED_ID_MISSING", lost)]
    named += [(code, per.where(where).select("packet_id", F.col(n).alias("n"))) for code, where, n in (("SEVERAL_CONVERSATIONS", "c > 1", "c"), ("SELECTED_TIME_UNKNOWN", "s > 0", "s"), ("CONTEXT_TIME_UNKNOWN", "u > 0", "u"))]
    return reduce(DataFrame.unionByName, [df.select("packet_id", F.lit(code).alias("code"), "n") for code, df in named])


def with_provenance(rows: DataFrame, provenance: DataFrame) -> DataFrame:
    """Adds source_record_keys, source_snapshot_keys, source_parser_versions (empty arrays where nothing is known) and source_provenance_status."""
    none = F.array().cast("array<string>")
    p = provenance.select("message_id", "source_record_keys", "source_snapshot_keys", F.col("parser_versions").alias("source_parser_versions"))
    joined = rows.join(p, "message_id", "left").withColumns({c: F.coalesce(F.col(c), none) for c in p.columns[1:]})
    return joined.withColumn("source_provenance_status", F.when((F.size("source_record_keys") > 0) & (F.size("source_snapshot_keys") > 0), "complete").otherwise("missing"))


def packet_headers(rows: DataFrame, required: bool = True) -> DataFrame:
    """What is told of each packet: its counts, the ids selected and those without a source."""
    lost = F.sort_array(F.collect_set(F.when(F.col("source_provenance_status") != "complete", F.col("message_id"))))
    per = rows.groupBy("packet_id").agg(F.count("*").alias("message_count"), F.count_if("selected").alias("selected_message_count"), F.sort_array(F.collect_list(F.when(F.col("selected"), F.col("message_id")))).alias("selected_message_ids"), lost.alias("source_provenance_missing_message_ids"))
    return per.withColumns({"source_provenance_required": F.lit(required), "source_provenance_status": F.when(F.size("source_provenance_missing_message_ids") == 0, "complete").otherwise("missing")})


def packet_faults(headers: DataFrame, rows: DataFrame) -> DataFrame:
    """The contract of packets (packet_id, code, severity, n): one aggregate over the rows and one join. Columns as packet_headers
    and with_provenance give them; headers without rows and rows without a header are faults too."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) == ""
    count = lambda condition, name: F.count_if(F.coalesce(condition, F.lit(True))).alias(name)
    per = rows.groupBy("packet_id").agg(
        F.count("*").alias("_n"), count(empty("message_id"), "_message"), count(empty("membership_id"), "_membership"), count(empty("conversation_id"), "_conversation"),
        (F.count("membership_id") - F.count_distinct("membership_id")).alias("_twice"), F.count_distinct("conversation_id").alias("_conversations"), F.count_if(F.col("timestamp_us").isNull()).alias("_time"),
        F.collect_set(F.when(F.col("selected"), F.col("message_id"))).alias("_flagged"),
        count((F.size("source_record_keys") <= 0) | (F.size("source_snapshot_keys") <= 0) | (F.size("source_parser_versions") <= 0), "_source"), count(F.col("source_provenance_status") != "complete", "_status"), F.lit(True).alias("_rows"),
    )
    h = headers.select("*", F.lit(True).alias("_header")).join(per, "packet_id", "full")
    ids, flagged = F.coalesce("selected_message_ids", F.array().cast("array<bigint>")), F.coalesce("_flagged", F.array().cast("array<bigint>"))
    required = F.coalesce("source_provenance_required", F.lit(False))
    yes = lambda condition: F.when(F.coalesce(condition, F.lit(False)), 1).otherwise(0)
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    checks = {
        "A6_PACKET_HEADER_MISSING": yes(F.col("_header").isNull()),
        "A6_PACKET_MESSAGES_INVALID": yes(F.col("_rows").isNull()),
        "A6_PACKET_SELECTED_IDS_DUPLICATE": F.size(ids) - F.size(F.array_distinct(ids)),
        "A6_PACKET_MESSAGE_ID_MISSING": n("_message"),
        "A6_PACKET_MEMBERSHIP_ID_MISSING": n("_membership"),
        "A6_PACKET_CONVERSATION_ID_MISSING": n("_conversation"),
        "A6_PACKET_MEMBERSHIP_DUPLICATE": n("_twice"),
        "A6_PACKET_MULTIPLE_CONVERSATIONS": F.when(F.col("_conversations") > 1, F.col("_conversations")).otherwise(0),
        "A6_PACKET_SELECTED_FLAG_MISMATCH": F.size(F.array_except(ids, flagged)) + F.size(F.array_except(flagged, ids)),
        "A6_PACKET_SELECTION_EMPTY": yes(F.size(ids) == 0),
        "A6_PACKET_UNKNOWN_TIMESTAMP": n("_time"),
        "A6_PACKET_SOURCE_PROVENANCE_MISSING": F.when(required, n("_source")).otherwise(0),
        "A6_PACKET_MESSAGE_PROVENANCE_STATUS_INVALID": F.when(required, n("_status")).otherwise(0),
        "A6_PACKET_MESSAGE_COUNT_MISMATCH": yes(F.col("message_count") != n("_n")),
        "A6_PACKET_SELECTED_COUNT_MISMATCH": yes(F.col("selected_message_count") != F.size(ids)),
        "A6_PACKET_PROVENANCE_MISSING_LIST_NONEMPTY": F.when(required, F.greatest(F.size(F.coalesce("source_provenance_missing_message_ids", F.array().cast("array<bigint>"))), F.lit(0))).otherwise(0),
        "A6_PACKET_SOURCE_PROVENANCE_STATUS_INVALID": yes(required & (F.coalesce("source_provenance_status", F.lit("")) != "complete")),
        "A6_PACKET_SOURCE_PROVENANCE_UNVERIFIED": yes(~required),
    }
    severity = lambda code: "WARNING" if code.endswith("UNVERIFIED") else "ERROR"
    each = F.array(*[F.struct(F.lit(code).alias("code"), F.lit(severity(code)).alias("severity"), c.cast("bigint").alias("n")) for code, c in checks.items()])
    return h.select("packet_id", F.explode(each).alias("c")).select("packet_id", "c.code", "c.severity", "c.n").where("n > 0")


def packet_records(rows: DataFrame, faults: DataFrame) -> DataFrame:
    """Rows of the packets without an error, as records in their order: position by time and id; a missing membership is made
    from conversation and message, a null text is empty."""
    good = rows.join(faults.where("severity = 'ERROR'").select("packet_id").distinct(), "packet_id", "left_anti")
    at = Window.partitionBy("packet_id").orderBy("timestamp_us", "message_id")
    made = F.concat(F.lit("compat:"), F.col("conversation_id").cast("string"), F.lit(":"), F.col("message_id").cast("string"))
    return good.withColumns({"membership_key": F.coalesce(F.nullif(F.col("membership_id").cast("string"), F.lit("")), made), "text": F.coalesce("text", F.lit("")), "position": F.row_number().over(at)})
