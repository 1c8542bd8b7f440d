"""Series of days, weeks and months without gaps, and what is read from them: change points, signals, regimes, slopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.numbers import fixed, let, sorted_median
from .behaviour import initiations

#: Metrics of a series in which change points and slopes are sought.
METRICS = ("message_count", "word_count", "turn_count", "initiations", "question_count", "affection_marker_count", "negative_marker_count", "median_response_latency_seconds", "median_response_effort_ratio")


def period_start(day: Column, kind: str) -> Column:
    return day if kind == "day" else F.to_date(F.date_trunc("week" if kind == "week" else "month", day))


def period_end(start: Column, kind: str) -> Column:
    return start if kind == "day" else F.date_add(start, 6) if kind == "week" else F.last_day(start)


def series(processed: DataFrame, turns: DataFrame, responses: DataFrame, kind: str = "day", newest: int | None = None) -> DataFrame:
    """A row for each period of a conversation, from its first to its last, and each participant with a dated message; with
    `newest` only so many last periods of it, which are the same for all its participants.

    Turns, starts of sessions and responses belong to the period of their turn's first message. The basis of a period is
    local if a message of it has a local date (an empty day: if any message of the participant has).
    """
    keys = ["conversation_id", "participant_id", "period_start"]
    p = lambda c: period_start(F.col(c), kind).alias("period_start")
    dated = processed.where("period_date IS NOT NULL")
    span = dated.groupBy("conversation_id").agg(F.min(period_start(F.col("period_date"), kind)).alias("_a"), F.max(period_start(F.col("period_date"), kind)).alias("_b"))
    step = {"day": "1 DAY", "week": "7 DAYS", "month": "1 MONTH"}[kind]
    if newest is not None:
        back = F.add_months("_b", 1 - newest) if kind == "month" else F.date_sub("_b", (newest - 1) * (7 if kind == "week" else 1))
        span = span.withColumn("_a", F.greatest("_a", back))
    who = dated.where("sender_id IS NOT NULL").groupBy("conversation_id", F.col("sender_id").alias("participant_id")).agg(F.max(F.col("local_date").isNotNull()).alias("_any_local"))
    spine = who.join(span, "conversation_id").select("conversation_id", "participant_id", "_any_local", F.explode(F.expr(f"sequence(_a, _b, INTERVAL {step})")).alias("period_start"))
    counts = dated.where("sender_id IS NOT NULL").groupBy("conversation_id", F.col("sender_id").alias("participant_id"), p("period_date")).agg(
        F.count("*").alias("message_count"), F.sum("word_count").alias("word_count"), F.sum("question_count").alias("question_count"), F.sum("affection_count").alias("affection_marker_count"),
        F.sum("negative_count").alias("negative_marker_count"), F.max(F.col("local_date").isNotNull()).alias("_local"), F.sort_array(F.collect_set("message_id")).alias("source_message_ids"),
    )
    by_turn = turns.where("participant_id IS NOT NULL AND period_date IS NOT NULL").groupBy("conversation_id", "participant_id", p("period_date")).agg(F.count("*").alias("turn_count"))
    by_start = initiations(turns).where("period_date IS NOT NULL").groupBy("conversation_id", "participant_id", p("period_date")).agg(F.count("*").alias("initiations"))
    by_response = responses.where("period_date IS NOT NULL").groupBy("conversation_id", F.col("responder_id").alias("participant_id"), p("period_date")).agg(
        (F.percentile("latency_us", 0.5) / 1e6).alias("median_response_latency_seconds"), F.median("effort_ratio").alias("median_response_effort_ratio")
    )
    joined = spine
    for other in (counts, by_turn, by_start, by_response):
        joined = joined.join(other, keys, "left")
    zero = joined.fillna(0, ["message_count", "word_count", "question_count", "affection_marker_count", "negative_marker_count", "turn_count", "initiations"])
    local = F.coalesce("_local", "_any_local" if kind == "day" else F.lit(False))
    return zero.select(
        "conversation_id", "participant_id", F.lit(kind).alias("period_kind"), "period_start", period_end(F.col("period_start"), kind).alias("period_end"), F.when(local, "local").otherwise("utc").alias("date_basis"),
        *METRICS, F.coalesce("source_message_ids", F.array().cast("array<bigint>")).alias("source_message_ids"),
    )


def robust_z(value: Column, history: Column) -> Column:
    """A struct of the history's median (center) and the value's distance from it (z): by the median absolute deviation,
    else the standard deviation, else a tenth of the median. The history is sorted once and its deviations once."""

    def deviation(h: Column) -> Column:
        n = F.size(h)
        total = lambda f: F.aggregate(h, F.lit(0.0), lambda a, x: a + f(x))
        return let(total(lambda x: x) / n, lambda mean: F.sqrt(total(lambda x: (x - mean) * (x - mean)) / n))

    def scaled(p: Column) -> Column:
        away = value - p.center
        plain = let(deviation(history), lambda sd: F.when(sd > 0, away / sd).otherwise(away / F.greatest(F.lit(1.0), 0.1 * F.abs(p.center))))
        mad = sorted_median(F.sort_array(F.transform(history, lambda x: F.abs(x - p.center))))
        return F.struct(p.center.alias("center"), let(mad, lambda m: F.when(m > 0, 0.67448975 * away / m).otherwise(plain)).alias("z"))

    return let(F.struct(sorted_median(F.sort_array(history)).alias("center")), scaled)


def _long(rows: DataFrame, metrics: tuple[str, ...]) -> DataFrame:
    """A row for each metric that is known."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    out = rows.select("conversation_id", "participant_id", "period_kind", "period_start", "period_end", "source_message_ids", F.explode(pairs).alias("m"))
    return out.select("conversation_id", "participant_id", "period_kind", "period_start", "period_end", "source_message_ids", "m.metric", "m.value").where("value IS NOT NULL")


def _history(rows: DataFrame, most: int | None) -> DataFrame:
    w = Window.partitionBy("conversation_id", "participant_id", "metric").orderBy("period_start").rowsBetween(-most if most else Window.unboundedPreceding, -1)
    return rows.withColumn("_history", F.collect_list("value").over(w))


def change_points(daily: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Known values that lie change_z robust deviations off the change_window known ones before them; they stay in the history."""
    rows = _history(_long(daily, METRICS), config.change_window).where(F.size("_history") >= config.change_min_history)
    scored = rows.withColumn("_s", robust_z(F.col("value"), F.col("_history"))).where(F.round(F.abs("_s.z"), 9) >= config.change_z)  # nine digits, lest rounding decides at the threshold
    return scored.select(
        "conversation_id", "participant_id", F.col("period_start").alias("period_date"), "metric", F.col("_s.center").alias("baseline"), "value", fixed(F.col("_s.z"), 6).alias("z_score"),
        F.when(F.col("_s.z") > 0, "increasing").otherwise("decreasing").alias("direction"), "source_message_ids",
    )


SIGNALS = (("activity", "message_count", 1.0), ("initiation", "initiations", 1.0), ("responsiveness", "median_response_latency_seconds", -1.0), ("effort", "median_response_effort_ratio", 1.0), ("questions", "question_count", 1.0), ("affection", "affection_marker_count", 1.0))


def engagement_signals(weekly: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Each week against the participant's own weeks before it, by six weighted components."""
    rows = _history(_long(weekly, tuple(m for _, m, _ in SIGNALS)), None).where(F.size("_history") >= config.regime_min_history)
    table = F.create_map(*[v for (n, m, p), w in zip(SIGNALS, config.regime_weights, strict=True) for v in (F.lit(m), F.struct(F.lit(n).alias("name"), F.lit(w).alias("weight"), F.lit(p).alias("polarity")))])
    known = rows.withColumn("_k", F.element_at(table, F.col("metric")))
    z = F.greatest(F.lit(-config.regime_clip), F.least(F.lit(config.regime_clip), robust_z(F.col("value"), F.col("_history")).getField("z") * F.col("_k.polarity")))
    scored = known.withColumn("_score", 100.0 * z / config.regime_clip)
    per = scored.groupBy("conversation_id", "participant_id", "period_start").agg(
        F.any_value("period_end").alias("period_end"), F.array_sort(F.collect_list(F.struct("_k.name", "_k.weight", F.col("_score").alias("score")))).alias("_c"), F.max_by("source_message_ids", "metric").alias("source_message_ids")
    )
    # Summed in one order, whatever order the rows came in.
    total = F.aggregate("_c", F.lit(0.0), lambda a, x: a + x.weight * x.score) / F.aggregate("_c", F.lit(0.0), lambda a, x: a + x.weight)
    direction = F.when(F.col("_t") >= config.regime_signal, "increase").when(F.col("_t") <= -config.regime_signal, "decrease").otherwise("stable")
    return per.withColumn("_t", total).select(
        "conversation_id", "participant_id", "period_start", "period_end", fixed(F.col("_t"), 6).alias("score"), direction.alias("direction"),
        F.map_from_entries(F.transform("_c", lambda x: F.struct(x["name"], fixed(x.score, 6)))).alias("component_scores"), "source_message_ids",
    )


def dyadic_regimes(signals: DataFrame) -> DataFrame:
    """Weeks in which exactly two participants have signals, by their two directions."""
    pairs = signals.groupBy("conversation_id", "period_start").agg(F.max("period_end").alias("period_end"), F.array_sort(F.collect_list(F.struct("participant_id", "direction", "score"))).alias("p"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("source_message_ids")))).alias("source_message_ids"))
    pairs = pairs.where(F.size("p") == 2).select("*", F.get("p", 0).alias("a"), F.get("p", 1).alias("b"))
    both = F.array_sort(F.array("a.direction", "b.direction"))
    one, two = F.get(both, 0), F.get(both, 1)
    kind = (
        F.when((one == "increase") & (two == "increase"), "mutual_approach").when((one == "decrease") & (two == "decrease"), "mutual_withdrawal").when((one == "decrease") & (two == "increase"), "opposing_directions")
        .when((one == "increase") & (two == "stable"), "one_sided_increase").when((one == "decrease") & (two == "stable"), "one_sided_decrease").otherwise("stable_or_mixed")
    )
    return pairs.select(
        "conversation_id", "period_start", "period_end", F.col("a.participant_id").alias("participant_a_id"), F.col("a.direction").alias("participant_a_direction"), F.col("a.score").alias("participant_a_score"),
        F.col("b.participant_id").alias("participant_b_id"), F.col("b.direction").alias("participant_b_direction"), F.col("b.score").alias("participant_b_score"), kind.alias("regime_type"), "source_message_ids",
    )


def trend_slopes(periods: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Least-squares slopes of the last weeks or months; unknown values are left out, not taken as zero."""
    newest = Window.partitionBy("conversation_id", "participant_id", "period_kind").orderBy(F.col("period_start").desc())
    size = F.when(F.col("period_kind") == "week", config.weekly_trend_periods).otherwise(config.monthly_trend_periods)
    numbered = periods.withColumn("_back", F.row_number().over(newest)).where(F.col("_back") <= size)
    oldest = Window.partitionBy("conversation_id", "participant_id", "period_kind").orderBy("period_start")
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("y")) for m in METRICS])
    rows = numbered.withColumn("x", F.row_number().over(oldest) - 1).select("conversation_id", "participant_id", "period_kind", "period_start", "period_end", "x", F.explode(pairs).alias("m")).where("m.y IS NOT NULL")
    per = rows.groupBy("conversation_id", "participant_id", "period_kind", "m.metric").agg(
        F.count("*").alias("window_periods"), F.min("period_start").alias("period_start"), F.max("period_end").alias("period_end"), F.min_by("m.y", "x").alias("first_value"), F.max_by("m.y", "x").alias("last_value"),
        F.regr_slope("m.y", "x").alias("_slope"), F.greatest(F.lit(1.0), F.median(F.abs("m.y"))).alias("_scale"),
    )
    known = per.where((F.col("window_periods") >= config.trend_min_periods) & F.col("_slope").isNotNull()).withColumn("_n", F.col("_slope") / F.col("_scale"))
    direction = F.when(F.col("_n") >= config.trend_slope, "increasing").when(F.col("_n") <= -config.trend_slope, "decreasing").otherwise("stable")
    change = F.when(F.col("first_value") != 0, (F.col("last_value") - F.col("first_value")) / F.abs("first_value"))
    return known.select(
        "conversation_id", "participant_id", "period_kind", "metric", "window_periods", "period_start", "period_end", "first_value", "last_value", fixed(F.col("_slope"), 9).alias("slope_per_period"),
        fixed(F.col("_n"), 9).alias("normalized_slope"), fixed(change, 9).alias("percent_change"), direction.alias("direction"),
    )


def findings(conflicts: DataFrame, changes: DataFrame, regimes: DataFrame) -> DataFrame:
    """Events, change points and regimes (but stable ones) in one schema: finding_id, kind, conversation_id, start_us, end_us, score."""
    us = lambda d: F.unix_micros(F.col(d).cast("timestamp"))
    day = 86_400_000_000
    a = conflicts.select(F.concat_ws(":", F.lit("event"), "conversation_id", "session_no").alias("finding_id"), F.col("event_type").alias("kind"), "conversation_id", "start_us", "end_us", "score")
    b = changes.select(F.concat_ws(":", F.lit("change"), "conversation_id", "participant_id", "metric", F.col("period_date").cast("string")).alias("finding_id"), F.lit("change_point").alias("kind"), "conversation_id", us("period_date").alias("start_us"), (us("period_date") + day - 1).alias("end_us"), F.abs("z_score").alias("score"))
    c = regimes.where("regime_type <> 'stable_or_mixed'").select(
        F.concat_ws(":", F.lit("regime"), "conversation_id", F.col("period_start").cast("string")).alias("finding_id"), F.concat(F.lit("regime:"), "regime_type").alias("kind"), "conversation_id",
        us("period_start").alias("start_us"), (us("period_end") + day - 1).alias("end_us"), F.greatest(F.abs("participant_a_score"), F.abs("participant_b_score")).alias("score"),
    )
    return a.unionByName(b).unionByName(c)
