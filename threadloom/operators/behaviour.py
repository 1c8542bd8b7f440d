"""Summaries of participants and conversations, time buckets, silences and conflict candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.numbers import fixed


def clamp(c: Column) -> Column:
    return F.when(c.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))  # least and greatest skip nulls


def is_night(hour: Column, config: Config = DEFAULT) -> Column:
    """Half-open, over midnight if the end is before the start."""
    a, b = config.night_start, config.night_end
    if a == b:
        return F.lit(False)
    return (hour >= a) & (hour < b) if a < b else (hour >= a) | (hour < b)


def time_buckets(processed: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Messages by participant, basis (local where known), kind of bucket and value, with the ids of all of them in their order."""
    known = processed.where("sender_id IS NOT NULL")
    hour, weekday = F.coalesce("local_hour", "utc_hour"), F.coalesce("local_weekday", "utc_weekday")
    hour_basis = F.when(F.col("local_hour").isNotNull(), "local").otherwise("utc")
    day_basis = F.when(F.col("local_weekday").isNotNull(), "local").otherwise("utc")
    row = lambda basis, kind, value, there: F.when(there.isNotNull(), F.struct(basis.alias("basis"), F.lit(kind).alias("kind"), value.alias("value")))
    buckets = F.array(
        row(hour_basis, "hour", F.lpad(hour.cast("string"), 2, "0"), hour),
        row(hour_basis, "night", F.when(is_night(hour, config), "night").otherwise("day"), hour),
        row(day_basis, "weekday", weekday.cast("string"), weekday),
        row(day_basis, "weekend", F.when(weekday >= 5, "weekend").otherwise("workday"), weekday),
    )
    rows = known.select("conversation_id", "sender_id", "message_id", "sequence_number", F.explode(F.filter(buckets, lambda b: b.isNotNull())).alias("b"))
    ids = F.transform(F.array_sort(F.collect_list(F.struct("sequence_number", "message_id"))), lambda x: x.message_id)
    return rows.groupBy("conversation_id", F.col("sender_id").alias("participant_id"), "b.basis", "b.kind", "b.value").agg(F.count("*").alias("message_count"), F.min("message_id").alias("first_message_id"), ids.alias("source_message_ids"))


def initiations(turns: DataFrame) -> DataFrame:
    """Sessions by the participant of their very first turn; nobody starts a session that an unknown sender starts."""
    first = turns.groupBy("conversation_id", "session_no").agg(F.min_by("participant_id", "turn_no").alias("participant_id"), F.min_by("period_date", "turn_no").alias("period_date"))
    return first.where("participant_id IS NOT NULL")


def participant_summary(processed: DataFrame, turns: DataFrame, responses: DataFrame, unanswered: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """A row for each known participant of a conversation, with everything counted, and the engagement score."""
    keys = ["conversation_id", "participant_id"]
    rows = processed.where("sender_id IS NOT NULL").withColumn("participant_id", F.col("sender_id"))
    hour, weekday = F.coalesce("local_hour", "utc_hour"), F.coalesce("local_weekday", "utc_weekday")
    counts = rows.groupBy(*keys).agg(
        F.count("*").alias("message_count"), F.sum("word_count").alias("word_count"), F.sum("char_count").alias("character_count"), F.count_distinct("period_date").alias("active_days"),
        F.sum("question_count").alias("question_count"), F.sum("exclamation_count").alias("exclamation_count"), F.sum("affection_count").alias("affection_marker_count"), F.sum("negative_count").alias("negative_marker_count"),
        F.count(hour).alias("clock_known_message_count"), F.count_if(weekday >= 5).alias("weekend_message_count"), F.count_if(is_night(hour, config)).alias("night_message_count"),
    )
    by_turn = turns.where("participant_id IS NOT NULL").groupBy(*keys).agg(F.count("*").alias("turn_count"))
    by_start = initiations(turns).groupBy(*keys).agg(F.count("*").alias("initiations"))
    by_end = unanswered.groupBy(*keys).agg(F.count("*").alias("unanswered_turn_count"))
    p = lambda q: (F.percentile("latency_us", q) / 1e6)
    by_response = responses.withColumnRenamed("responder_id", "participant_id").groupBy(*keys).agg(
        F.count("*").alias("response_turn_count"), F.count("latency_us").alias("latency_sample_count"), (F.sum("latency_us") / F.count("latency_us") / 1e6).alias("mean_response_latency_seconds"),
        p(0.5).alias("median_response_latency_seconds"), p(0.25).alias("p25_response_latency_seconds"), p(0.75).alias("p75_response_latency_seconds"), p(0.9).alias("p90_response_latency_seconds"),
        F.median("effort_ratio").alias("median_response_effort_ratio"),
    )
    joined = counts
    for other in (by_turn, by_start, by_end, by_response):
        joined = joined.join(other, keys, "left")
    whole = Window.partitionBy("conversation_id")
    zero = joined.fillna(0, ["turn_count", "initiations", "unanswered_turn_count", "response_turn_count", "latency_sample_count"])
    shared = zero.select("*", (F.col("initiations") / F.greatest(F.sum("initiations").over(whole), F.lit(1))).alias("initiation_share"), (F.col("turn_count") / F.greatest(F.sum("turn_count").over(whole), F.lit(1))).alias("_turn_share"))
    of_turns = lambda c: clamp(F.col(c) / F.greatest(F.col("turn_count"), F.lit(1)))
    responsive = F.when(F.col("latency_sample_count") > 0, 1.0 - clamp(F.col("median_response_latency_seconds") / config.responsiveness_seconds)).otherwise(0.0)
    parts = (F.col("_turn_share"), F.col("initiation_share"), responsive, of_turns("question_count"), of_turns("affection_marker_count"))
    score = sum((F.lit(w) * c for w, c in zip(config.engagement_weights, parts, strict=True)), F.lit(0.0)) * 100
    return shared.withColumn("engagement_score", fixed(score, 6)).drop("_turn_share")


def reciprocity(summary: DataFrame) -> DataFrame:
    """The smaller over the larger of two participants; null for other numbers of them, 1 where both are 0."""
    ratio = lambda c: F.when(F.count("*") == 2, F.when(F.max(c) == 0, 1.0).otherwise(F.min(c) / F.max(c)))
    return summary.groupBy("conversation_id").agg(
        ratio("message_count").alias("message_reciprocity"), ratio("word_count").alias("word_reciprocity"), ratio("turn_count").alias("turn_reciprocity"), ratio("initiations").alias("initiation_reciprocity")
    )


def conversation_summary(processed: DataFrame, turns: DataFrame) -> DataFrame:
    messages = processed.groupBy("conversation_id").agg(
        F.count("*").alias("message_count"), F.count_distinct("sender_id").alias("participant_count"), F.count_if(F.col("sender_id").isNull()).alias("unknown_sender_count"),
        F.count_if(F.col("timestamp_us").isNull()).alias("unknown_time_count"), F.min("timestamp_us").alias("first_us"), F.max("timestamp_us").alias("last_us"), F.max("session_no").alias("session_count"),
    )
    return messages.join(turns.groupBy("conversation_id").agg(F.count("*").alias("turn_count")), "conversation_id", "left")


def _session_ends(turns: DataFrame) -> DataFrame:
    known = F.when(F.col("participant_id").isNotNull(), F.col("turn_no"))
    return turns.groupBy("conversation_id", "session_no").agg(
        F.min("turn_no").alias("first_turn"), F.max("turn_no").alias("last_turn"), F.min_by("start_us", "turn_no").alias("start_us"), F.max_by("end_us", "turn_no").alias("end_us"),
        F.max_by("participant_id", known).alias("last_known"), F.min_by("participant_id", known).alias("first_known"),
        F.max_by("message_ids", "turn_no").alias("last_ids"), F.min_by("message_ids", "turn_no").alias("first_ids"),
    )


def silence_events(turns: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Gaps of long_silence_seconds and more between sessions whose ends are known, with who spoke last and who came back."""
    w = Window.partitionBy("conversation_id").orderBy("first_turn")
    ahead = lambda c: F.lead(c).over(w)
    rows = _session_ends(turns).select("*", ahead("session_no").alias("next_session_no"), ahead("start_us").alias("_start"), ahead("first_known").alias("return_participant_id"), ahead("first_ids").alias("_ids"))
    gap = F.col("_start") - F.col("end_us")
    return rows.where(gap >= config.long_silence_seconds * 1_000_000).select(
        "conversation_id", "session_no", "next_session_no", gap.alias("gap_us"), F.col("last_known").alias("before_participant_id"), "return_participant_id",
        F.array_distinct(F.concat("last_ids", "_ids")).alias("source_message_ids"),
    )


def conflict_candidates(turns: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Sessions whose weighted signs of conflict reach the threshold, with the signs."""
    w = Window.partitionBy("conversation_id").orderBy("turn_no")
    step = F.col("start_us") - F.lag("end_us").over(w)
    rows = turns.withColumn("_step", F.when((F.lag("session_no").over(w) == F.col("session_no")) & (step >= 0), step))
    per = rows.groupBy("conversation_id", "session_no").agg(
        F.count("*").alias("turn_count"), F.sum("negative_count").alias("_negative"), F.sum("exclamation_count").alias("_exclamations"), F.count("_step").alias("_steps"),
        F.count_if(F.col("_step") <= config.rapid_seconds * 1_000_000).alias("_rapid"), F.min("turn_no").alias("_first"), F.min_by("start_us", "turn_no").alias("start_us"), F.max_by("end_us", "turn_no").alias("end_us"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("turn_no", "message_ids"))), lambda x: x.message_ids)).alias("source_message_ids"),
    )
    silence = F.lead("start_us").over(Window.partitionBy("conversation_id").orderBy("_first")) - F.col("end_us")
    signs = per.select(
        "conversation_id", "session_no", "turn_count", "start_us", "end_us", "source_message_ids",
        clamp(F.col("_negative") / F.col("turn_count")).alias("negative_factor"), F.when(F.col("_steps") > 0, F.col("_rapid") / F.col("_steps")).otherwise(0.0).alias("rapid_factor"),
        clamp(F.col("_exclamations") / (2 * F.col("turn_count"))).alias("exclamation_factor"), F.coalesce(clamp(silence / (config.post_silence_seconds * 1_000_000)), F.lit(0.0)).alias("silence_factor"),
    )
    names = ("negative_factor", "rapid_factor", "exclamation_factor", "silence_factor")
    score = sum((F.lit(v) * F.col(n) for v, n in zip(config.conflict_weights, names, strict=True)), F.lit(0.0))
    # Compared to nine digits, lest the order of a sum decides.
    scored = signs.withColumn("_score", score).where(F.round("_score", 9) >= config.conflict_threshold)
    return scored.select("conversation_id", "session_no", F.lit("conflict_candidate").alias("event_type"), F.round("_score", 6).alias("score"), *[F.round(n, 6).alias(n) for n in names], "turn_count", "start_us", "end_us", "source_message_ids")
