"""Snapshots of evidence that assertions carry, against the context they were made from: messages, their sources, and metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a snapshot of a message and one of a metric repeat of their context.
MESSAGE = ("timestamp_us", "sender_id", "membership_id", "source_record_keys", "source_snapshot_keys", "parser_versions")
PROVENANCE = ("analytics_run_id", "analytics_version", "analysis_signature", "source_fingerprint", "processing_run_id")


def _codes(rows: DataFrame, keys: list[str], cases: dict[str, Column]) -> DataFrame:
    """(context_id, path, code, n) of rows at fault; a null path where the whole context is."""
    faults = F.array_compact(F.array(*[F.when(c, code) for code, c in cases.items()]))
    path = F.col("path") if "path" in keys else F.lit(None).cast("string")
    return rows.select("context_id", path.alias("path"), F.explode(faults).alias("code")).groupBy("context_id", "path", "code").agg(F.count("*").alias("n"))


def snapshot_faults(contexts: DataFrame, messages: DataFrame, metrics: DataFrame, evidence: DataFrame, message_snapshots: DataFrame, metric_snapshots: DataFrame) -> DataFrame:
    """Faults (context_id, path, code, n) of the evidence of assertions, each named by its path in its context.

    contexts: context_id, missing_message_ids and omitted_message_ids (arrays), omitted_message_count, omitted_sha256,
    quality_warnings (an array) and PROVENANCE; messages: context_id, message_id and MESSAGE; metrics: context_id, phase, name,
    value; evidence: context_id, path, message_ids (an array, in order); message_snapshots: context_id, path, position (from
    0), message_id and MESSAGE; metric_snapshots: context_id, path, phase, name, value and PROVENANCE. Values are compared as
    they are, a null equals a null. A message that a context has twice is a fault of it, and matches with either.
    """
    at = ["context_id", "path"]
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    left_out = F.coalesce(F.col("omitted_message_count"), F.lit(0)) != 0
    said = F.exists(F.coalesce("quality_warnings", F.array().cast("array<string>")), lambda w: F.coalesce(F.lower(w).contains("omitted"), F.lit(False)))
    whole = _codes(contexts, [], {
        "CONTEXT_MISSING_EVIDENCE": size("missing_message_ids") > 0, "CONTEXT_OMISSION_COUNT_DIFFERS": left_out & (F.col("omitted_message_count") != F.greatest(size("omitted_message_ids"), F.lit(0))),
        "CONTEXT_OMISSION_HASH_MISSING": left_out & (F.coalesce("omitted_sha256", F.lit("")) == ""), "CONTEXT_OMISSION_NOT_DISCLOSED": left_out & ~said,
    })
    repeated = _codes(messages.groupBy("context_id", "message_id").count().where("count > 1"), [], {"CONTEXT_MESSAGE_REPEATED": F.lit(True)})
    empty = _codes(evidence, at, {"EVIDENCE_EMPTY": F.coalesce(F.size("message_ids"), F.lit(0)) <= 0})

    # Lists and their snapshots, place by place; a place that one side lacks is a fault as well.
    listed = evidence.select(*at, F.posexplode("message_ids").alias("position", "_listed"))
    both = listed.join(message_snapshots.select(*at, "position", F.col("message_id").alias("_shown"), F.lit(True).alias("_there")), [*at, "position"], "full")
    places = _codes(both, at, {"MESSAGE_SNAPSHOT_DIFFERS_FROM_LIST": F.col("_there").isNull() | ~F.col("_listed").eqNullSafe(F.col("_shown"))})

    seen = message_snapshots.withColumn("_is", F.struct(*MESSAGE))
    kept = messages.groupBy("context_id", "message_id").agg(F.collect_set(F.struct(*MESSAGE)).alias("_was"), F.max(F.coalesce(F.size("source_record_keys"), F.lit(0))).alias("_keys"))
    held = seen.join(kept, ["context_id", "message_id"], "left")
    same = F.exists("_was", lambda m: m.eqNullSafe(F.col("_is")))
    messages_off = _codes(held, at, {
        "MESSAGE_OUTSIDE_CONTEXT": F.col("_was").isNull(), "MESSAGE_PROVENANCE_DIFFERS": F.col("_was").isNotNull() & ~same, "SOURCE_RECORD_DROPPED": F.col("_was").isNotNull() & (F.col("_keys") > 0) & (size("source_record_keys") <= 0),
    })

    told = metrics.groupBy("context_id", "phase", "name").agg(F.first("value").alias("_value"), F.lit(True).alias("_known"))
    origin = contexts.select("context_id", *[F.col(c).alias(f"_{c}") for c in PROVENANCE])
    shown = metric_snapshots.join(told, ["context_id", "phase", "name"], "left").join(origin, "context_id", "left")
    known = F.coalesce("_known", F.lit(False))
    metrics_off = _codes(shown, at, {
        "METRIC_OUTSIDE_CONTEXT": ~known, "METRIC_VALUE_DIFFERS": known & ~F.col("value").eqNullSafe(F.col("_value")),
        "METRIC_PROVENANCE_DIFFERS": known & reduce(lambda x, y: x | y, [~F.col(c).eqNullSafe(F.col(f"_{c}")) for c in PROVENANCE]),
    })
    return reduce(DataFrame.unionByName, [whole, repeated, empty, places, messages_off, metrics_off])
