"""Queries of order, turns, summaries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import sql_fixed
from ..operators import behaviour as bh
from ..operators import structure as st
from . import adapters as ad


def _processed(spark, sf_dir: str) -> DataFrame:
    return st.processed(ad.sparse(spark, sf_dir), ad.EVENTS)


def _turns(spark, sf_dir: str) -> DataFrame:
    return st.turns(_processed(spark, sf_dir))


def text_features(spark, sf_dir: str) -> DataFrame:
    rows = st.text_features(ad.table(spark, sf_dir, "documents").select("doc_id", "text"), ad.CHATS)
    return rows.select("doc_id", "word_count", "char_count", "line_count", "emoji_count", "question_count", "exclamation_count", F.round("uppercase_ratio", 6).alias("uppercase_ratio"), "has_url", "affection_count", "negative_count")


TEXT_FEATURES = r"""SELECT doc_id, len(regexp_extract_all(text, '[^\s\x{0B}\x{85}\p{Z}]+')) AS word_count, length(text) AS char_count, length(text) - length(replace(text, chr(10), '')) + 1 AS line_count,
  len(regexp_extract_all(text, '[\x{1F300}-\x{1FAFF}\x{2600}-\x{26FF}\x{2700}-\x{27BF}]')) AS emoji_count, length(text) - length(replace(text, '?', '')) AS question_count, length(text) - length(replace(text, '!', '')) AS exclamation_count,
  round(CASE WHEN len(regexp_extract_all(text, '\p{L}')) > 0 THEN len(regexp_extract_all(text, '\p{Lu}'))::DOUBLE / len(regexp_extract_all(text, '\p{L}')) ELSE 0 END, 6) AS uppercase_ratio,
  regexp_matches(text, '(?i)(?:https?://|www\.)\S+') AS has_url, (length(lower(text)) - length(replace(lower(text), 'une', ''))) // 3 AS affection_count, (length(lower(text)) - length(replace(lower(text), 'pas', ''))) // 3 AS negative_count FROM documents"""


def calendar_parts(spark, sf_dir: str) -> DataFrame:
    rows = st.calendar(ad.sparse(spark, sf_dir))
    return rows.select("message_id", F.col("utc_date").cast("string").alias("utc_date"), "utc_weekday", "utc_hour", F.col("local_date").cast("string").alias("local_date"), "local_weekday", "local_hour")


def structured(spark, sf_dir: str) -> DataFrame:
    rows = st.structured(ad.sparse(spark, sf_dir))
    return rows.select("membership_id", "conversation_id", "sequence_number", "run_no", "session_no", F.round("seconds_since_previous", 3).alias("seconds_since_previous"), F.round("seconds_since_other", 3).alias("seconds_since_other"))


def turns(spark, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir).withColumns({"message_ids": F.array_join("message_ids", ","), "period_date": F.col("period_date").cast("string")})


def response_samples(spark, sf_dir: str) -> DataFrame:
    return st.response_samples(_turns(spark, sf_dir)).withColumns({"effort_ratio": F.round("effort_ratio", 6), "period_date": F.col("period_date").cast("string")})


def unanswered(spark, sf_dir: str) -> DataFrame:
    return st.unanswered_turns(_turns(spark, sf_dir)).select("conversation_id", "session_no", "turn_no", "participant_id")


_LATENCIES = ("mean_response_latency_seconds", "median_response_latency_seconds", "p25_response_latency_seconds", "p75_response_latency_seconds", "p90_response_latency_seconds")


def _summary(spark, sf_dir: str) -> DataFrame:
    p = _processed(spark, sf_dir)
    t = st.turns(p)
    return bh.participant_summary(p, t, st.response_samples(t), st.unanswered_turns(t), ad.EVENTS)


def participant_summary(spark, sf_dir: str) -> DataFrame:
    return _summary(spark, sf_dir).withColumns({**{c: F.round(c, 3) for c in _LATENCIES}, "median_response_effort_ratio": F.round("median_response_effort_ratio", 6), "initiation_share": F.round("initiation_share", 6)})


def reciprocity(spark, sf_dir: str) -> DataFrame:
    r = bh.reciprocity(_summary(spark, sf_dir))
    return r.select("conversation_id", *[F.round(c, 6).alias(c) for c in r.columns if c != "conversation_id"])


def conversation_summary(spark, sf_dir: str) -> DataFrame:
    p = _processed(spark, sf_dir)
    return bh.conversation_summary(p, st.turns(p))


def time_buckets(spark, sf_dir: str) -> DataFrame:
    return bh.time_buckets(_processed(spark, sf_dir), ad.EVENTS).withColumn("source_message_ids", F.array_join("source_message_ids", ","))


def turn_texts(spark, sf_dir: str) -> DataFrame:
    return st.turn_texts(_processed(spark, sf_dir)).select("conversation_id", "turn_no", F.md5("text").alias("text_md5"))


def silence_events(spark, sf_dir: str) -> DataFrame:
    return bh.silence_events(_turns(spark, sf_dir), ad.EVENTS).withColumn("source_message_ids", F.array_join("source_message_ids", ","))


def conflict_candidates(spark, sf_dir: str) -> DataFrame:
    return bh.conflict_candidates(_turns(spark, sf_dir), ad.EVENTS).withColumn("source_message_ids", F.array_join("source_message_ids", ","))


_BASE = "WITH " + ad.sql_processed(ad.SQL_SPARSE, ad.EVENTS)
_UNANSWERED = """un AS (SELECT * FROM turns a WHERE participant_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM turns b WHERE b.conversation_id = a.conversation_id AND b.session_no = a.session_no AND b.turn_no > a.turn_no AND b.participant_id IS NOT NULL AND b.participant_id <> a.participant_id))"""
_INIT = """ini AS (SELECT conversation_id, session_no, arg_min_null(participant_id, turn_no) AS participant_id, arg_min_null(period_date, turn_no) AS period_date FROM turns GROUP BY ALL),
init AS (SELECT * FROM ini WHERE participant_id IS NOT NULL)"""
_INIT = _INIT.replace("GROUP BY ALL", "GROUP BY conversation_id, session_no")
_SUMMARY = f"""{_UNANSWERED}, {_INIT},
c AS (SELECT conversation_id, sender_id AS participant_id, count(*) AS message_count, sum(words)::BIGINT AS word_count, sum(chars)::BIGINT AS character_count, count(DISTINCT period_date) AS active_days, sum(q)::BIGINT AS question_count, sum(ex)::BIGINT AS exclamation_count,
  sum(aff)::BIGINT AS affection_marker_count, sum(neg)::BIGINT AS negative_marker_count, count(u) AS clock_known_message_count, count(*) FILTER (WHERE isodow(coalesce(l, u)) >= 6) AS weekend_message_count, count(*) FILTER (WHERE hour(coalesce(l, u)) < 6) AS night_message_count
  FROM pm WHERE sender_id IS NOT NULL GROUP BY 1, 2),
tc AS (SELECT conversation_id, participant_id, count(*) AS turn_count FROM turns WHERE participant_id IS NOT NULL GROUP BY 1, 2),
ic AS (SELECT conversation_id, participant_id, count(*) AS initiations FROM init GROUP BY 1, 2),
uc AS (SELECT conversation_id, participant_id, count(*) AS unanswered_turn_count FROM un GROUP BY 1, 2),
rc AS (SELECT conversation_id, responder_id AS participant_id, count(*) AS response_turn_count, count(latency_us) AS latency_sample_count, sum(latency_us)::DOUBLE / count(latency_us) / 1e6 AS mean_l, quantile_cont(latency_us::DOUBLE, 0.5) / 1e6 AS p50, quantile_cont(latency_us::DOUBLE, 0.25) / 1e6 AS p25,
  quantile_cont(latency_us::DOUBLE, 0.75) / 1e6 AS p75, quantile_cont(latency_us::DOUBLE, 0.9) / 1e6 AS p90, quantile_cont(effort, 0.5) AS eff FROM resp GROUP BY 1, 2),
j AS (SELECT c.*, coalesce(turn_count, 0) AS turn_count, coalesce(initiations, 0) AS initiations, coalesce(unanswered_turn_count, 0) AS unanswered_turn_count, coalesce(response_turn_count, 0) AS response_turn_count, coalesce(latency_sample_count, 0) AS latency_sample_count,
  CASE WHEN latency_sample_count > 0 THEN mean_l END AS mean_l, p50, p25, p75, p90, eff FROM c LEFT JOIN tc USING (conversation_id, participant_id) LEFT JOIN ic USING (conversation_id, participant_id) LEFT JOIN uc USING (conversation_id, participant_id) LEFT JOIN rc USING (conversation_id, participant_id)),
k AS (SELECT *, initiations::DOUBLE / greatest(sum(initiations) OVER w, 1) AS ishare, turn_count::DOUBLE / greatest(sum(turn_count) OVER w, 1) AS tshare FROM j WINDOW w AS (PARTITION BY conversation_id)),
sm AS (SELECT * EXCLUDE (mean_l, p50, p25, p75, p90, eff, ishare, tshare), round(ishare, 6) AS initiation_share, round(mean_l, 3) AS mean_response_latency_seconds, round(p50, 3) AS median_response_latency_seconds, round(p25, 3) AS p25_response_latency_seconds, round(p75, 3) AS p75_response_latency_seconds,
  round(p90, 3) AS p90_response_latency_seconds, round(eff, 6) AS median_response_effort_ratio, {sql_fixed('''100 * (0.25 * tshare + 0.2 * ishare + 0.25 * CASE WHEN latency_sample_count > 0 THEN 1 - least(1, p50 / 21600) ELSE 0 END
  + 0.15 * least(1, question_count::DOUBLE / greatest(turn_count, 1)) + 0.15 * least(1, affection_marker_count::DOUBLE / greatest(turn_count, 1)))''', 6)} AS engagement_score FROM k)"""


def _ratio(c: str) -> str:
    return f"CASE WHEN count(*) = 2 THEN round(CASE WHEN max({c}) = 0 THEN 1 ELSE min({c})::DOUBLE / max({c}) END, 6) END"


QUERIES = {
    "text_features": text_features, "calendar_parts": calendar_parts, "message_structure": structured, "sequence_number": lambda s, d: structured(s, d).select("membership_id", "conversation_id", "sequence_number"),
    "prev_gaps": lambda s, d: structured(s, d).select("membership_id", "seconds_since_previous", "seconds_since_other"), "sender_runs": lambda s, d: st.sender_runs(ad.sparse(s, d)), "sessions": lambda s, d: st.sessions(ad.sparse(s, d)),
    "turns": turns, "response_samples": response_samples, "unanswered_turns": unanswered, "participant_summary": participant_summary, "reciprocity": reciprocity, "conversation_summary": conversation_summary,
    "time_buckets": time_buckets, "turn_texts": turn_texts, "silence_events": silence_events, "conflict_candidates": conflict_candidates,
}
_STRUCTURE = f"""{_BASE}, ru AS (SELECT conversation_id, run_no, max(timestamp_us) AS m FROM st GROUP BY 1, 2), rp AS (SELECT *, max(m) OVER (PARTITION BY conversation_id ORDER BY run_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS other FROM ru)"""
ORACLES = {
    "text_features": TEXT_FEATURES,
    "calendar_parts": f"{_BASE} SELECT message_id, u::DATE::VARCHAR AS utc_date, isodow(u) - 1 AS utc_weekday, hour(u) AS utc_hour, l::DATE::VARCHAR AS local_date, isodow(l) - 1 AS local_weekday, hour(l) AS local_hour FROM pm",
    "message_structure": f"{_STRUCTURE} SELECT membership_id, conversation_id, seq AS sequence_number, run_no, session_no, round((timestamp_us - p_us) / 1e6, 3) AS seconds_since_previous, round((timestamp_us - other) / 1e6, 3) AS seconds_since_other FROM st JOIN rp USING (conversation_id, run_no)",
    "sequence_number": f"{_BASE} SELECT membership_id, conversation_id, seq AS sequence_number FROM st",
    "prev_gaps": f"{_STRUCTURE} SELECT membership_id, round((timestamp_us - p_us) / 1e6, 3) AS seconds_since_previous, round((timestamp_us - other) / 1e6, 3) AS seconds_since_other FROM st JOIN rp USING (conversation_id, run_no)",
    "sender_runs": f"{_BASE} SELECT conversation_id, run_no, any_value(sender_id) AS sender_id, count(*) AS message_count, min(seq) AS first_sequence, max(seq) AS last_sequence, arg_min_null(timestamp_us, seq) AS first_us, arg_max_null(timestamp_us, seq) AS last_us FROM st GROUP BY 1, 2",
    "sessions": f"{_BASE} SELECT conversation_id, session_no, count(*) AS message_count, min(seq) AS first_sequence, max(seq) AS last_sequence, min(timestamp_us) AS start_us, max(timestamp_us) AS end_us, count(DISTINCT sender_id) AS senders FROM st GROUP BY 1, 2",
    "turns": f"{_BASE} SELECT conversation_id, turn_no, session_no, participant_id, message_count, start_us, end_us, period_date::VARCHAR AS period_date, words AS word_count, chars AS char_count, q AS question_count, ex AS exclamation_count, aff AS affection_count, neg AS negative_count, array_to_string(ids, ',') AS message_ids FROM turns",
    "response_samples": f"{_BASE} SELECT conversation_id, session_no, turn_no, responder_id, from_id, period_date::VARCHAR AS period_date, latency_us, round(effort, 6) AS effort_ratio FROM resp",
    "unanswered_turns": f"{_BASE}, {_UNANSWERED} SELECT conversation_id, session_no, turn_no, participant_id FROM un",
    "participant_summary": f"{_BASE}, {_SUMMARY} SELECT * FROM sm",
    "reciprocity": f"{_BASE}, {_SUMMARY} SELECT conversation_id, {_ratio('message_count')} AS message_reciprocity, {_ratio('word_count')} AS word_reciprocity, {_ratio('turn_count')} AS turn_reciprocity, {_ratio('initiations')} AS initiation_reciprocity FROM sm GROUP BY conversation_id",
    "conversation_summary": f"{_BASE} SELECT conversation_id, message_count, participant_count, unknown_sender_count, unknown_time_count, first_us, last_us, session_count, turn_count FROM (SELECT conversation_id, count(*) AS message_count, count(DISTINCT sender_id) AS participant_count, count(*) FILTER (WHERE sender_id IS NULL) AS unknown_sender_count, count(*) FILTER (WHERE timestamp_us IS NULL) AS unknown_time_count, min(timestamp_us) AS first_us, max(timestamp_us) AS last_us, max(session_no) AS session_count FROM pm GROUP BY 1) JOIN (SELECT conversation_id, count(*) AS turn_count FROM turns GROUP BY 1) USING (conversation_id)",
    "time_buckets": f"""{_BASE}, b AS (SELECT conversation_id, sender_id AS participant_id, message_id, seq, CASE WHEN l IS NULL THEN 'utc' ELSE 'local' END AS basis, coalesce(l, u) AS x FROM pm WHERE sender_id IS NOT NULL AND u IS NOT NULL),
  v AS (SELECT *, 'hour' AS kind, lpad(hour(x)::VARCHAR, 2, '0') AS value FROM b UNION ALL SELECT *, 'night', CASE WHEN hour(x) < 6 THEN 'night' ELSE 'day' END FROM b UNION ALL SELECT *, 'weekday', (isodow(x) - 1)::VARCHAR FROM b UNION ALL SELECT *, 'weekend', CASE WHEN isodow(x) >= 6 THEN 'weekend' ELSE 'workday' END FROM b)
  SELECT conversation_id, participant_id, basis, kind, value, count(*) AS message_count, min(message_id) AS first_message_id, string_agg(message_id::VARCHAR, ',' ORDER BY seq) AS source_message_ids FROM v GROUP BY 1, 2, 3, 4, 5""",
    "turn_texts": f"{_BASE} SELECT conversation_id, turn_no, md5(coalesce(string_agg(text, chr(10) ORDER BY seq) FILTER (WHERE text <> ''), '')) AS text_md5 FROM t1 GROUP BY 1, 2",
    "silence_events": f"""{_BASE}, se AS (SELECT conversation_id, session_no, min(turn_no) AS ft, max(turn_no) AS lt, arg_min_null(start_us, turn_no) AS s, arg_max_null(end_us, turn_no) AS e, arg_max(participant_id, turn_no) AS lk, arg_min(participant_id, turn_no) AS fk, arg_max(ids, turn_no) AS li, arg_min(ids, turn_no) AS fi FROM turns GROUP BY 1, 2),
  n AS (SELECT *, lead(session_no) OVER w AS ns, lead(s) OVER w AS nx, lead(fk) OVER w AS rk, lead(fi) OVER w AS ni FROM se WINDOW w AS (PARTITION BY conversation_id ORDER BY ft))
  SELECT conversation_id, session_no, ns AS next_session_no, nx - e AS gap_us, lk AS before_participant_id, rk AS return_participant_id, array_to_string(list_concat(li, ni), ',') AS source_message_ids FROM n WHERE nx - e >= 86400000000""",
    "conflict_candidates": f"""{_BASE}, x AS (SELECT *, CASE WHEN lag(session_no) OVER w = session_no AND start_us - lag(end_us) OVER w >= 0 THEN start_us - lag(end_us) OVER w END AS step FROM turns WINDOW w AS (PARTITION BY conversation_id ORDER BY turn_no)),
  g AS (SELECT conversation_id, session_no, count(*) AS turn_count, sum(neg) AS n, sum(ex) AS ex, count(step) AS steps, count(*) FILTER (WHERE step <= 300000000) AS rapid, min(turn_no) AS ft, arg_min_null(start_us, turn_no) AS start_us, arg_max_null(end_us, turn_no) AS end_us, flatten(list(ids ORDER BY turn_no)) AS ids FROM x GROUP BY 1, 2),
  h AS (SELECT *, least(1, n::DOUBLE / turn_count) AS a, CASE WHEN steps > 0 THEN rapid::DOUBLE / steps ELSE 0 END AS b, least(1, ex::DOUBLE / (2 * turn_count)) AS c, coalesce(least(1.0, greatest(0.0, (lead(start_us) OVER (PARTITION BY conversation_id ORDER BY ft) - end_us) / 64800000000.0)), 0) AS d FROM g)
  SELECT conversation_id, session_no, 'conflict_candidate' AS event_type, round(0.45::DOUBLE * a + 0.25::DOUBLE * b + 0.15::DOUBLE * c + 0.15::DOUBLE * d, 6) AS score, round(a, 6) AS negative_factor, round(b, 6) AS rapid_factor, round(c, 6) AS exclamation_factor, round(d::DOUBLE, 6) AS silence_factor, turn_count, start_us, end_us, array_to_string(ids, ',') AS source_message_ids FROM h
  WHERE round(0.45::DOUBLE * a + 0.25::DOUBLE * b + 0.15::DOUBLE * c + 0.15::DOUBLE * d, 9) >= {ad.EVENTS.conflict_threshold}""",
}
