"""The driver's tables as messages, in Spark and in DuckDB SQL. Each adapter has the columns that operators.structure names."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT

#: Events and orders have other words than chats: these are their markers, and their series are short.
EVENTS = replace(DEFAULT, affection_markers=("signup", "purchase"), negative_markers=("error",), regime_min_history=2, trend_min_periods=2, conflict_threshold=0.3)
ORDERS = replace(DEFAULT, affection_markers=("LOW",), negative_markers=("URGENT",))
CHATS = replace(DEFAULT, affection_markers=("une",), negative_markers=("pas",), topic_min_df=2)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two users are a conversation; all is known."""
    e = table(spark, sf_dir, "events")
    mark = F.when(F.col("event_type") == "error", "!").when(F.col("event_type") == "view", "?").otherwise("")
    return e.select(
        F.col("event_id").alias("membership_id"), F.col("event_id").alias("message_id"), F.floor(F.col("user_id") / 2).alias("conversation_id"), F.col("user_id").alias("sender_id"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("timestamp_us"), F.concat("event_type", F.lit(" "), F.coalesce("props", F.lit("")), mark).alias("text"), F.col("event_id").alias("source_order"),
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("source_message_id"), F.lit(None).cast("int").alias("timezone_offset_min"),
    )


def sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events, some of unknown sender, some of unknown time, two thirds with a known offset."""
    e = events(spark, sf_dir)
    i = F.col("message_id")
    return e.withColumns({"sender_id": F.when(i % 17 != 0, F.col("sender_id")), "timestamp_us": F.when(i % 23 != 0, F.col("timestamp_us")), "timezone_offset_min": F.when(i % 3 != 0, 60)})


def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    i = (F.col("conv_id") * 100 + F.col("turn")).alias("message_id")
    us = F.lit(1_704_067_200_000_000) + F.col("conv_id") * 3_600_000_000 + F.col("turn") * 60_000_000
    return c.select(
        i.alias("membership_id"), i, F.col("conv_id").alias("conversation_id"), F.when(F.col("role") == "user", 1).when(F.col("role") == "assistant", 2).cast("bigint").alias("sender_id"), us.alias("timestamp_us"), "text",
        F.col("turn").alias("source_order"), F.lit(None).cast("string").alias("source_message_id"), F.lit(None).cast("int").alias("timezone_offset_min"),
    )


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("membership_id"), F.col("o_orderkey").alias("message_id"), F.floor(F.col("o_custkey") / 2).alias("conversation_id"), F.col("o_custkey").alias("sender_id"),
        F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("timestamp_us"), F.col("o_orderpriority").alias("text"), F.col("o_orderkey").alias("source_order"), F.lit(None).cast("string").alias("source_message_id"),
        F.lit(None).cast("int").alias("timezone_offset_min"),
    )


def repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with copies: a second later under a new source id, and under the same one."""
    e = events(spark, sf_dir)
    some = e.where(F.col("message_id") % 50 == 0)
    def moved(n: int) -> DataFrame:
        return some.withColumns({"message_id": F.col("message_id") + n, "membership_id": F.col("membership_id") + n, "timestamp_us": F.col("timestamp_us") + 1_000_000})

    return e.unionByName(moved(10**9).withColumn("source_message_id", F.concat(F.lit("x"), F.col("message_id").cast("string")))).unionByName(moved(2 * 10**9))


def memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events, some of which are in a second conversation as well."""
    e = events(spark, sf_dir).withColumn("is_primary", F.lit(True))
    again = e.where(F.col("message_id") % 40 == 0).withColumns({"membership_id": F.col("membership_id") + 10**9, "conversation_id": F.col("conversation_id") + 1000, "is_primary": F.lit(False)})
    return e.unionByName(again)


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = table(spark, sf_dir, "events").select("user_id").distinct()
    return u.select(F.col("user_id").alias("participant_id"), F.concat(F.lit("User "), (F.col("user_id") % 40).cast("string")).alias("canonical_name"), (F.col("user_id") % 50 == 0).alias("is_self"))


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").where("turn > 0 AND (conv_id + turn) % 3 <> 0")
    i = F.col("conv_id") * 100 + F.col("turn")
    return c.select(i.alias("source_message_id"), (i - 1).alias("target_message_id"), F.lit("reply_to").alias("relation_type"))


# The same in DuckDB: CTEs named msg.
SQL_EVENTS = """msg AS (SELECT event_id AS membership_id, event_id AS message_id, user_id // 2 AS conversation_id, user_id AS sender_id, epoch_us(ts) AS timestamp_us,
  event_type || ' ' || coalesce(props, '') || CASE event_type WHEN 'error' THEN '!' WHEN 'view' THEN '?' ELSE '' END AS text, event_id AS source_order, 'e' || event_id AS source_message_id, NULL::BIGINT AS tz FROM events)"""
SQL_SPARSE = """msg AS (SELECT event_id AS membership_id, event_id AS message_id, user_id // 2 AS conversation_id, CASE WHEN event_id % 17 <> 0 THEN user_id END AS sender_id, CASE WHEN event_id % 23 <> 0 THEN epoch_us(ts) END AS timestamp_us,
  event_type || ' ' || coalesce(props, '') || CASE event_type WHEN 'error' THEN '!' WHEN 'view' THEN '?' ELSE '' END AS text, event_id AS source_order, 'e' || event_id AS source_message_id, (CASE WHEN event_id % 3 <> 0 THEN 60 END)::BIGINT AS tz FROM events)"""
SQL_CHATS = """msg AS (SELECT conv_id * 100 + turn AS membership_id, conv_id * 100 + turn AS message_id, conv_id AS conversation_id, CASE role WHEN 'user' THEN 1 WHEN 'assistant' THEN 2 END::BIGINT AS sender_id,
  1704067200000000 + conv_id * 3600000000 + turn * 60000000 AS timestamp_us, text, turn AS source_order, NULL::VARCHAR AS source_message_id, NULL::BIGINT AS tz FROM conversations)"""
SQL_ORDERS = """msg AS (SELECT o_orderkey AS membership_id, o_orderkey AS message_id, o_custkey // 2 AS conversation_id, o_custkey AS sender_id, epoch_us(o_orderdate::TIMESTAMP) AS timestamp_us,
  o_orderpriority AS text, o_orderkey AS source_order, NULL::VARCHAR AS source_message_id, NULL::BIGINT AS tz FROM orders)"""


def sql_hits(markers: tuple[str, ...]) -> str:
    return " + ".join(f"(length(lower(text)) - length(replace(lower(text), '{m.lower()}', ''))) // {len(m)}" for m in markers)


def sql_processed(source: str, config=DEFAULT) -> str:
    """CTEs from msg to pm (processed) to turns and responses."""
    return f"""{source},
o AS (SELECT *, row_number() OVER w AS seq, lag(timestamp_us) OVER w AS p_us, lag(sender_id) OVER w AS p_s FROM msg WINDOW w AS (PARTITION BY conversation_id ORDER BY timestamp_us NULLS LAST, source_order NULLS LAST, coalesce(source_message_id, ''), message_id, membership_id)),
fl AS (SELECT *, CASE WHEN seq = 1 OR sender_id IS DISTINCT FROM p_s THEN 1 ELSE 0 END AS r, CASE WHEN seq = 1 OR timestamp_us IS NULL OR p_us IS NULL OR timestamp_us - p_us > {config.session_gap_seconds}000000 THEN 1 ELSE 0 END AS s FROM o),
st AS (SELECT *, (sum(r) OVER c)::BIGINT AS run_no, (sum(s) OVER c)::BIGINT AS session_no FROM fl WINDOW c AS (PARTITION BY conversation_id ORDER BY seq)),
pm AS (SELECT *, make_timestamp(timestamp_us) AS u, make_timestamp(timestamp_us + tz * 60000000) AS l, coalesce(make_timestamp(timestamp_us + tz * 60000000), make_timestamp(timestamp_us))::DATE AS period_date,
  len(regexp_extract_all(text, '\\S+')) AS words, length(text) AS chars, length(text) - length(replace(text, '?', '')) AS q, length(text) - length(replace(text, '!', '')) AS ex, {sql_hits(config.affection_markers)} AS aff, {sql_hits(config.negative_markers)} AS neg FROM st),
t0 AS (SELECT *, CASE WHEN seq = 1 OR sender_id IS DISTINCT FROM lag(sender_id) OVER c OR session_no <> lag(session_no) OVER c THEN 1 ELSE 0 END AS t FROM pm WINDOW c AS (PARTITION BY conversation_id ORDER BY seq)),
t1 AS (SELECT *, (sum(t) OVER (PARTITION BY conversation_id ORDER BY seq))::BIGINT AS turn_no FROM t0),
turns AS (SELECT conversation_id, turn_no, any_value(session_no) AS session_no, any_value(sender_id) AS participant_id, count(*) AS message_count, arg_min_null(timestamp_us, seq) AS start_us, arg_max_null(timestamp_us, seq) AS end_us,
  arg_min_null(period_date, seq) AS period_date, sum(words)::BIGINT AS words, sum(chars)::BIGINT AS chars, sum(q)::BIGINT AS q, sum(ex)::BIGINT AS ex, sum(aff)::BIGINT AS aff, sum(neg)::BIGINT AS neg, list(message_id ORDER BY seq) AS ids FROM t1 GROUP BY conversation_id, turn_no),
resp AS (SELECT conversation_id, session_no, turn_no, participant_id AS responder_id, p AS from_id, period_date, CASE WHEN start_us - e >= 0 THEN start_us - e END AS latency_us, words::DOUBLE / greatest(w, 1) AS effort FROM (
  SELECT *, lag(participant_id) OVER c AS p, lag(session_no) OVER c AS ps, lag(end_us) OVER c AS e, lag(words) OVER c AS w FROM turns WINDOW c AS (PARTITION BY conversation_id ORDER BY turn_no)) WHERE ps = session_no AND p IS NOT NULL AND participant_id IS NOT NULL AND p <> participant_id)"""


# From c (conversation_id, kind, s, e, v, and n, the place by start) to what merge_candidates folds it into; for WITH RECURSIVE.
SQL_FOLD = """  f AS (SELECT conversation_id, kind, n, s, e, v, 1::BIGINT AS merged, 1 AS g FROM c WHERE n = 1 UNION ALL SELECT conversation_id, kind, n, CASE WHEN j THEN fs ELSE s END, CASE WHEN j THEN greatest(fe, e) ELSE e END, CASE WHEN j THEN greatest(fv, v) ELSE v END, CASE WHEN j THEN fm + 1 ELSE 1 END, CASE WHEN j THEN g ELSE g + 1 END
    FROM (SELECT c.*, f.s AS fs, f.e AS fe, f.v AS fv, f.merged AS fm, f.g AS g, least(f.e, c.e) > greatest(f.s, c.s) AND (least(f.e, c.e) - greatest(f.s, c.s))::DOUBLE / least(greatest(f.e - f.s, 1000000), greatest(c.e - c.s, 1000000)) >= 0.7 AS j FROM f JOIN c ON c.conversation_id = f.conversation_id AND c.kind = f.kind AND c.n = f.n + 1))
  SELECT conversation_id, kind, s AS start_us, e AS end_us, v AS importance, merged FROM f QUALIFY row_number() OVER (PARTITION BY conversation_id, kind, g ORDER BY n DESC) = 1"""
