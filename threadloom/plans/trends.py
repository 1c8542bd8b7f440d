"""Queries of series, change points, signals, regimes, slopes and findings, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import fixed, sql_fixed
from ..operators import behaviour as bh
from ..operators import readers as rd
from ..operators import series as se
from ..operators import structure as st
from ..operators.graph import kept
from . import adapters as ad
from . import core, lexical


def _series(spark, sf_dir: str, kind: str, adapter=ad.sparse, config=ad.EVENTS, newest: int | None = None) -> DataFrame:
    p = st.processed(adapter(spark, sf_dir), config)
    t = st.turns(p)
    return se.series(p, t, st.response_samples(t), kind, newest)


def _shown(rows: DataFrame) -> DataFrame:
    return rows.withColumns({
        "period_start": F.col("period_start").cast("string"), "period_end": F.col("period_end").cast("string"), "median_response_latency_seconds": F.round("median_response_latency_seconds", 3),
        "median_response_effort_ratio": F.round("median_response_effort_ratio", 6), "source_message_ids": F.array_join("source_message_ids", ","),
    })


def _changes(spark, sf_dir: str) -> DataFrame:
    return se.change_points(_series(spark, sf_dir, "day"), ad.EVENTS)


def change_points(spark, sf_dir: str) -> DataFrame:
    rows = _changes(spark, sf_dir)
    return rows.withColumns({"period_date": F.col("period_date").cast("string"), "baseline": fixed(F.col("baseline"), 3), "value": fixed(F.col("value"), 3), "source_message_ids": F.array_join("source_message_ids", ",")})


def _signals(spark, sf_dir: str) -> DataFrame:
    return se.engagement_signals(_series(spark, sf_dir, "week"), ad.EVENTS)


def engagement_signals(spark, sf_dir: str) -> DataFrame:
    parts = [F.try_element_at("component_scores", F.lit(n)).alias(n) for n, _, _ in se.SIGNALS]
    return _signals(spark, sf_dir).select("conversation_id", "participant_id", F.col("period_start").cast("string").alias("period_start"), "score", "direction", *parts)


def dyadic_regimes(spark, sf_dir: str) -> DataFrame:
    r = se.dyadic_regimes(_signals(spark, sf_dir))
    return r.withColumns({"period_start": F.col("period_start").cast("string"), "period_end": F.col("period_end").cast("string"), "source_message_ids": F.array_join("source_message_ids", ",")})


def trend_slopes(spark, sf_dir: str) -> DataFrame:
    periods = _series(spark, sf_dir, "week", ad.orders, ad.ORDERS, ad.ORDERS.weekly_trend_periods).unionByName(_series(spark, sf_dir, "month", ad.orders, ad.ORDERS, ad.ORDERS.monthly_trend_periods))
    rows = se.trend_slopes(periods, ad.ORDERS)
    return rows.withColumns({"period_start": F.col("period_start").cast("string"), "period_end": F.col("period_end").cast("string"), "first_value": fixed(F.col("first_value"), 3), "last_value": fixed(F.col("last_value"), 3)})


def _parts(spark, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Turns, change points and signals (kept, without messages) of the events, from messages and turns that are kept once."""
    p = kept(st.processed(ad.sparse(spark, sf_dir), ad.EVENTS).drop("text"))
    t = kept(st.turns(p))
    r = st.response_samples(t)
    signals = se.engagement_signals(se.series(p, t, r, "week"), ad.EVENTS).drop("component_scores", "source_message_ids")
    return t, se.change_points(se.series(p, t, r, "day"), ad.EVENTS), kept(signals).withColumn("source_message_ids", F.array().cast("array<bigint>"))


def findings_union(spark, sf_dir: str) -> DataFrame:
    t, changes, signals = _parts(spark, sf_dir)
    return se.findings(bh.conflict_candidates(t, ad.EVENTS), changes, se.dyadic_regimes(signals))


PIVOTED = {"message_count": True, "initiations": True, "median_response_latency_seconds": False}


def daily_pivot(spark, sf_dir: str) -> DataFrame:
    rows = rd.daily_pivot(_series(spark, sf_dir, "day"), PIVOTED)
    return rows.withColumns({"period_start": F.col("period_start").cast("string"), **{c: fixed(F.col(c), 3) for c in rows.columns if c.startswith("median_")}})


def candidate_rows(spark, sf_dir: str) -> DataFrame:
    t, changes, signals = _parts(spark, sf_dir)
    topics = lexical.topic_candidates(spark, sf_dir).withColumns({c: F.col(c).cast("date") for c in ("first_date", "last_date")})
    return rd.ai_candidates(bh.conflict_candidates(t, ad.EVENTS), changes, signals, se.dyadic_regimes(signals), topics)


def candidate_merge(spark, sf_dir: str) -> DataFrame:
    return rd.merge_candidates(candidate_rows(spark, sf_dir))


def sql_series(kind: str, source: str, config) -> str:
    """CTEs up to ser: the series of one kind of period."""
    start = {"day": "{0}", "week": "date_trunc('week', {0})::DATE", "month": "date_trunc('month', {0})::DATE"}[kind].format
    step = {"day": "1 day", "week": "7 days", "month": "1 month"}[kind]
    end = {"day": "d", "week": "(d + INTERVAL 6 DAY)::DATE", "month": "last_day(d)"}[kind]
    other = "any_local" if kind == "day" else "false"
    return f"""WITH {ad.sql_processed(source, config)}, {core._INIT},
dm AS (SELECT *, {start('period_date')} AS d FROM pm WHERE period_date IS NOT NULL),
sp AS (SELECT conversation_id, min(d) AS a, max(d) AS b FROM dm GROUP BY 1),
wh AS (SELECT conversation_id, sender_id AS participant_id, bool_or(l IS NOT NULL) AS any_local FROM dm WHERE sender_id IS NOT NULL GROUP BY 1, 2),
spine AS (SELECT conversation_id, participant_id, any_local, unnest(generate_series(a, b, INTERVAL '{step}'))::DATE AS d FROM wh JOIN sp USING (conversation_id)),
mc AS (SELECT conversation_id, sender_id AS participant_id, d, count(*) AS message_count, sum(words)::BIGINT AS word_count, sum(q)::BIGINT AS question_count, sum(aff)::BIGINT AS affection_marker_count, sum(neg)::BIGINT AS negative_marker_count, bool_or(l IS NOT NULL) AS loc, list(DISTINCT message_id ORDER BY message_id) AS ids FROM dm WHERE sender_id IS NOT NULL GROUP BY 1, 2, 3),
tt AS (SELECT conversation_id, participant_id, {start('period_date')} AS d, count(*) AS turn_count FROM turns WHERE participant_id IS NOT NULL AND period_date IS NOT NULL GROUP BY 1, 2, 3),
ii AS (SELECT conversation_id, participant_id, {start('period_date')} AS d, count(*) AS initiations FROM init WHERE period_date IS NOT NULL GROUP BY 1, 2, 3),
rr AS (SELECT conversation_id, responder_id AS participant_id, {start('period_date')} AS d, quantile_cont(latency_us::DOUBLE, 0.5) / 1e6 AS lat, quantile_cont(effort, 0.5) AS eff FROM resp WHERE period_date IS NOT NULL GROUP BY 1, 2, 3),
ser AS (SELECT conversation_id, participant_id, d, {end} AS e, CASE WHEN coalesce(loc, {other}) THEN 'local' ELSE 'utc' END AS date_basis, coalesce(message_count, 0) AS message_count, coalesce(word_count, 0) AS word_count, coalesce(turn_count, 0) AS turn_count, coalesce(initiations, 0) AS initiations,
  coalesce(question_count, 0) AS question_count, coalesce(affection_marker_count, 0) AS affection_marker_count, coalesce(negative_marker_count, 0) AS negative_marker_count, lat, eff, coalesce(ids, []) AS ids
  FROM spine LEFT JOIN mc USING (conversation_id, participant_id, d) LEFT JOIN tt USING (conversation_id, participant_id, d) LEFT JOIN ii USING (conversation_id, participant_id, d) LEFT JOIN rr USING (conversation_id, participant_id, d))"""


def _series_sql(kind: str, source: str, config) -> str:
    return sql_series(kind, source, config) + f""" SELECT conversation_id, participant_id, '{kind}' AS period_kind, d::VARCHAR AS period_start, e::VARCHAR AS period_end, date_basis, message_count, word_count, turn_count, initiations, question_count, affection_marker_count, negative_marker_count,
  round(lat, 3) AS median_response_latency_seconds, round(eff, 6) AS median_response_effort_ratio, array_to_string(ids, ',') AS source_message_ids FROM ser"""


_COUNTS = ("message_count", "word_count", "turn_count", "initiations", "question_count", "affection_marker_count", "negative_marker_count")


def _unpivot(metrics: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT conversation_id, participant_id, d, e, ids, '{m}' AS metric, {c}::DOUBLE AS y FROM ser" for m, c in metrics.items())


def _z(frame: str) -> str:
    """Medians and deviations step by step as the operators take them."""
    median = "({0}[(len({0}) + 1) // 2] + {0}[len({0}) // 2 + 1]) / 2".format
    return f"""h0 AS (SELECT *, coalesce(list(y) OVER w, []) AS hl FROM lg WHERE y IS NOT NULL WINDOW w AS (PARTITION BY conversation_id, participant_id, metric ORDER BY d ROWS BETWEEN {frame} PRECEDING AND 1 PRECEDING)),
h1 AS (SELECT *, len(hl) AS n, list_sort(hl) AS hs, list_sum(hl) / len(hl) AS mean FROM h0),
h2 AS (SELECT *, CASE WHEN n > 0 THEN {median('hs')} END AS c, sqrt(list_sum(list_transform(hl, lambda x: (x - mean) * (x - mean))) / n) AS s FROM h1),
h3 AS (SELECT *, list_sort(list_transform(hl, lambda x: abs(x - c))) AS ds FROM h2), h AS (SELECT *, CASE WHEN n > 0 THEN {median('ds')} END AS m FROM h3),
z AS (SELECT *, CASE WHEN m > 0 THEN 0.67448975::DOUBLE * (y - c) / m WHEN s > 0 THEN (y - c) / s ELSE (y - c) / greatest(1.0::DOUBLE, 0.1::DOUBLE * abs(c)) END AS z FROM h)"""


_PARTS = ", ".join(f"max({sql_fixed('sc', 6)}) FILTER (WHERE metric = '{m}') AS {n}" for n, m, _ in se.SIGNALS)
_NAME = "CASE metric " + " ".join(f"WHEN '{m}' THEN '{n}'" for n, m, _ in se.SIGNALS) + " END"
_NINE = {**{m: m for m in _COUNTS}, "median_response_latency_seconds": "lat", "median_response_effort_ratio": "eff"}
_WEEK = sql_series("week", ad.SQL_SPARSE, ad.EVENTS)
_SIGNAL_SQL = f"""{_WEEK}, lg AS ({_unpivot({'message_count': 'message_count', 'initiations': 'initiations', 'median_response_latency_seconds': 'lat', 'median_response_effort_ratio': 'eff', 'question_count': 'question_count', 'affection_marker_count': 'affection_marker_count'})}),
{_z('UNBOUNDED')},
sg AS (SELECT *, CASE metric WHEN 'message_count' THEN 0.25 WHEN 'initiations' THEN 0.2 WHEN 'median_response_latency_seconds' THEN 0.2 WHEN 'median_response_effort_ratio' THEN 0.15 ELSE 0.1 END::DOUBLE AS w, greatest(-2.5::DOUBLE, least(2.5::DOUBLE, z * CASE metric WHEN 'median_response_latency_seconds' THEN -1 ELSE 1 END)) * 100 / 2.5::DOUBLE AS sc, {_NAME} AS name FROM z WHERE n >= 2),
sig AS (SELECT conversation_id, participant_id, d, any_value(e) AS e, list_sum(list(w * sc ORDER BY name)) / list_sum(list(w ORDER BY name)) AS score, {_PARTS}, any_value(ids) AS ids FROM sg GROUP BY 1, 2, 3),
sgn AS (SELECT *, CASE WHEN score >= 10 THEN 'increase' WHEN score <= -10 THEN 'decrease' ELSE 'stable' END AS direction FROM sig)"""



def _slopes_sql(kind: str, size: int) -> str:
    return f"""WITH {sql_series(kind, ad.SQL_ORDERS, ad.ORDERS).removeprefix('WITH ')}, n AS (SELECT *, row_number() OVER (PARTITION BY conversation_id, participant_id ORDER BY d DESC) AS back FROM ser), k AS (SELECT *, row_number() OVER (PARTITION BY conversation_id, participant_id ORDER BY d) - 1 AS x FROM n WHERE back <= {size}),
  lg AS ({_unpivot(_NINE).replace(' AS metric,', ' AS metric, x,').replace('FROM ser', 'FROM k')}),
  g AS (SELECT conversation_id, participant_id, metric, count(*) AS window_periods, min(d) AS a, max(e) AS b, arg_min(y, x) AS f, arg_max(y, x) AS l, regr_slope(y, x) AS sl, greatest(1, median(abs(y))) AS sc FROM lg WHERE y IS NOT NULL GROUP BY 1, 2, 3)
  SELECT conversation_id, participant_id, '{kind}' AS period_kind, metric, window_periods, a::VARCHAR AS period_start, b::VARCHAR AS period_end, {sql_fixed('f', 3)} AS first_value, {sql_fixed('l', 3)} AS last_value, {sql_fixed('sl', 9)} AS slope_per_period, {sql_fixed('sl / sc', 9)} AS normalized_slope,
  CASE WHEN f <> 0 THEN {sql_fixed('(l - f) / abs(f)', 9)} END AS percent_change, CASE WHEN sl / sc >= 0.05 THEN 'increasing' WHEN sl / sc <= -0.05 THEN 'decreasing' ELSE 'stable' END AS direction FROM g WHERE window_periods >= 4 AND sl IS NOT NULL"""


_CHANGES = f"""{sql_series('day', ad.SQL_SPARSE, ad.EVENTS)}, lg AS ({_unpivot(_NINE)}), {_z('28')}
  SELECT conversation_id, participant_id, d::VARCHAR AS period_date, metric, {sql_fixed('c', 3)} AS baseline, {sql_fixed('y', 3)} AS value, {sql_fixed('z', 6)} AS z_score, CASE WHEN z > 0 THEN 'increasing' ELSE 'decreasing' END AS direction, array_to_string(ids, ',') AS source_message_ids FROM z WHERE n >= 7 AND round(abs(z), 9) >= 2.5"""
_REGIMES = f"""{_SIGNAL_SQL}, p AS (SELECT conversation_id, d, max(e) AS e, list(participant_id ORDER BY participant_id) AS w, list(direction ORDER BY participant_id) AS di, list({sql_fixed('score', 6)} ORDER BY participant_id) AS ss, list_sort(list(direction)) AS b, list_sort(list_distinct(flatten(list(ids)))) AS ids FROM sgn GROUP BY 1, 2 HAVING count(*) = 2)
  SELECT conversation_id, d::VARCHAR AS period_start, e::VARCHAR AS period_end, w[1] AS participant_a_id, di[1] AS participant_a_direction, ss[1] AS participant_a_score, w[2] AS participant_b_id, di[2] AS participant_b_direction, ss[2] AS participant_b_score, CASE array_to_string(b, '/') WHEN 'increase/increase' THEN 'mutual_approach' WHEN 'decrease/decrease' THEN 'mutual_withdrawal'
  WHEN 'decrease/increase' THEN 'opposing_directions' WHEN 'increase/stable' THEN 'one_sided_increase' WHEN 'decrease/stable' THEN 'one_sided_decrease' ELSE 'stable_or_mixed' END AS regime_type, array_to_string(ids, ',') AS source_message_ids FROM p"""
_FINDINGS = f"""SELECT 'event:' || conversation_id || ':' || session_no AS finding_id, event_type AS kind, conversation_id, start_us, end_us, score::DOUBLE AS score FROM ({core.ORACLES['conflict_candidates']})
  UNION ALL SELECT 'change:' || conversation_id || ':' || participant_id || ':' || metric || ':' || period_date, 'change_point', conversation_id, epoch_us(period_date::TIMESTAMP), epoch_us(period_date::TIMESTAMP) + 86399999999, abs(z_score) FROM ({_CHANGES})
  UNION ALL SELECT 'regime:' || conversation_id || ':' || period_start, 'regime:' || regime_type, conversation_id, epoch_us(period_start::TIMESTAMP), epoch_us(period_end::TIMESTAMP) + 86399999999, greatest(abs(participant_a_score), abs(participant_b_score)) FROM ({_REGIMES}) WHERE regime_type <> 'stable_or_mixed'"""


def _pivot_sql() -> str:
    columns = []
    for m, counts in PIVOTED.items():
        c = {"median_response_latency_seconds": "lat"}.get(m, m)
        for i in (1, 2, 3):
            name = f"{m}_{i}" if i < 3 else f"{m}_more"
            columns.append(f"coalesce(sum({c}) FILTER (WHERE r = {i}), 0)::BIGINT AS {name}" if counts else f"{sql_fixed(f'arg_min({c}, participant_id) FILTER (WHERE r = {i} AND {c} IS NOT NULL)', 3)} AS {name}")
    return f"{sql_series('day', ad.SQL_SPARSE, ad.EVENTS)}, pr AS (SELECT *, least(dense_rank() OVER (PARTITION BY conversation_id ORDER BY participant_id), 3) AS r FROM ser) SELECT conversation_id, d::VARCHAR AS period_start, {', '.join(columns)} FROM pr GROUP BY 1, 2"


QUERIES = {
    "daily_metrics": lambda s, d: _shown(_series(s, d, "day")), "weekly_metrics": lambda s, d: _shown(_series(s, d, "week")), "monthly_metrics": lambda s, d: _shown(_series(s, d, "month", ad.orders, ad.ORDERS)),
    "change_points": change_points, "engagement_signals": engagement_signals, "dyadic_regimes": dyadic_regimes, "trend_slopes": trend_slopes, "findings_union": findings_union, "daily_pivot": daily_pivot, "candidate_merge": candidate_merge,
}
ORACLES = {
    "daily_metrics": _series_sql("day", ad.SQL_SPARSE, ad.EVENTS),
    "weekly_metrics": _series_sql("week", ad.SQL_SPARSE, ad.EVENTS),
    "monthly_metrics": _series_sql("month", ad.SQL_ORDERS, ad.ORDERS),
    "change_points": _CHANGES,
    "engagement_signals": f"{_SIGNAL_SQL} SELECT conversation_id, participant_id, d::VARCHAR AS period_start, {sql_fixed('score', 6)} AS score, direction, {', '.join(n for n, _, _ in se.SIGNALS)} FROM sgn",
    "dyadic_regimes": _REGIMES,
    "trend_slopes": f"SELECT * FROM ({_slopes_sql('week', 8)}) UNION ALL SELECT * FROM ({_slopes_sql('month', 6)})",
    "findings_union": _FINDINGS,
    "daily_pivot": _pivot_sql(),
    "candidate_merge": f"""WITH RECURSIVE u AS (SELECT conversation_id, 'conflict' AS kind, start_us AS s, end_us AS e, score::DOUBLE * 100 AS v FROM ({core.ORACLES['conflict_candidates']})
  UNION ALL SELECT conversation_id, 'change', epoch_us(period_date::TIMESTAMP), epoch_us(period_date::TIMESTAMP) + {rd.DAY - 1}, greatest(60.0::DOUBLE, least(100.0::DOUBLE, abs(z_score) * 20)) FROM ({_CHANGES})
  UNION ALL SELECT conversation_id, 'engagement', epoch_us(d::TIMESTAMP), epoch_us(e::TIMESTAMP) + {rd.DAY - 1}, CASE direction WHEN 'stable' THEN 50 ELSE 80 END::DOUBLE FROM ({_SIGNAL_SQL} SELECT conversation_id, d, e, direction FROM sgn)
  UNION ALL SELECT conversation_id, 'regime', epoch_us(period_start::TIMESTAMP), epoch_us(period_end::TIMESTAMP) + {rd.DAY - 1}, CASE regime_type WHEN 'stable_or_mixed' THEN 50 ELSE 85 END::DOUBLE FROM ({_REGIMES})
  UNION ALL SELECT conversation_id, 'topic', epoch_us(first_date::TIMESTAMP), epoch_us(last_date::TIMESTAMP) + {rd.DAY - 1}, 65::DOUBLE FROM ({lexical.ORACLES['topic_candidates']})),
  c AS (SELECT *, row_number() OVER (PARTITION BY conversation_id, kind ORDER BY s, e, v) AS n FROM u WHERE s IS NOT NULL AND e IS NOT NULL),
{ad.SQL_FOLD}""",
}
