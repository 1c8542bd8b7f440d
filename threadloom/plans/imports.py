"""Queries of imports: messages resolved part by part, and what was staged."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import canonical, incremental, inventory
from ..session import shared_dir
from ..sources import staged
from ..sources.publication import Publication
from . import adapters as ad
from . import identity


def incremental_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of resolved_messages, imported in four parts of which the last ones have the smallest ids, the second one twice."""
    store = Publication(spark, f"{shared_dir(spark)}/imports-{uuid.uuid4().hex[:12]}")
    rows = identity.records_to_resolve(ad.table(spark, sf_dir, "events"))
    for part in (3, 1, 1, 2, 0):
        incremental.resolve(store, rows.where(F.pmod(F.xxhash64("guid", "source_pk"), F.lit(4)) == part), f"part-{part}")
    return incremental.current(store)


def staged_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a staged bundle and read back: what of them are messages, and what errors. Some values have no form in JSON, some keys are missing."""
    e = ad.table(spark, sf_dir, "events")
    i = F.col("event_id")
    value = F.when(i % 97 == 0, F.lit(float("nan"))).when(i % 89 == 0, F.lit(float("inf"))).otherwise(F.col("value"))
    records = e.select(i.cast("string").alias("source_message_id"), F.when(i % 101 != 0, F.concat(F.lit("k"), i.cast("string"))).alias("source_record_key"), F.concat("event_type", F.lit(" č\n\""), "props").alias("text"), value.alias("value"))
    path = f"{shared_dir(spark)}/staged-{uuid.uuid4().hex[:12]}"
    staged.write_staged(records, path, "events", "0" * 64, ("plans", "1"))
    good = staged.read_staged(spark, path, "source_message_id string, source_record_key string, text string, value double", allow_errors=True)
    bad = staged.read_errors(spark, path).select("source_message_id", "source_record_key", F.lit(None).cast("string").alias("text"), F.lit(None).cast("double").alias("value"), "error_type")
    return good.withColumn("error_type", F.lit(None).cast("string")).unionByName(bad)


def source_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The account of a database whose messages are the events, with faults of each kind put in by their ids."""
    e = ad.table(spark, sf_dir, "events").select(F.col("event_id").alias("i"), F.floor(F.col("user_id") / 2).alias("chat"))
    every = lambda n: F.col("i") % n == 0
    links = e.where(~every(77)).select(F.col("i").alias("ROWID"), F.when(every(83), -F.col("i") - 1).when(~every(91), F.col("i")).alias("message_id"), F.col("chat").alias("chat_id"), "i")
    source = {
        "message": e.select(F.col("i").alias("ROWID")), "chat_message_join": links.drop("i").union(links.where(every(50)).select(F.col("ROWID") + 10**9, "message_id", "chat_id")),
        "attachment": e.where(every(10) & ~every(170)).select(F.col("i").alias("ROWID")).union(e.where(every(190)).select(-F.col("i") - 1)),
        "message_attachment_join": e.where(every(10)).select(F.col("i").alias("ROWID"), F.col("i").alias("message_id"), F.col("i").alias("attachment_id")),
    }
    sound = ~every(77) & ~every(83) & ~every(91)
    named = lambda key, chat: F.struct(key.alias("key"), chat.cast("bigint").alias("chat_id"))
    key = F.concat(F.lit("c"), F.col("chat").cast("string"))
    conversations = F.array_compact(F.array(
        F.when(sound & ~every(107), named(key, F.col("chat"))), F.when(~sound & ~every(71), named(F.concat(F.lit("orphan:"), F.col("i").cast("string")), F.lit(None))), F.when(every(109), named(F.lit("c-1"), F.lit(-1))),
    ))
    records = e.where(~every(97) & ~every(103)).select(
        F.col("i").alias("message_id"), F.when(every(113), "other").otherwise(F.get(conversations, F.lit(0))["key"]).alias("conversation_id"), conversations.alias("conversations"), F.when(every(10) & ~every(130) & ~every(170), F.array("i")).alias("attachments"),
    )
    return inventory.source_account(source, records.union(records.where("message_id % 101 = 0")), e.where(every(103)).select(F.col("i").alias("message_id")))


def local_time_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with what up to three sources say of their local time; some agree, some don't, some can't be."""
    e = ad.table(spark, sf_dir, "events").select(F.col("event_id").alias("i"), F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss").alias("t"))
    iso = lambda n, *ends: F.concat("t", F.get(F.array(*[F.lit(x) for x in ends]), (F.col("i") % n).cast("int")))
    no_time, no_offset = F.lit(None).cast("string"), F.lit(None).cast("int")
    messages = e.select(F.col("i").alias("message_id"), F.when(F.col("i") % 4 == 0, 60).alias("timezone_offset_min"), F.when(F.col("i") % 9 == 0, F.concat("t", F.lit("+01:00"))).alias("local_iso"))
    parts = [
        e.where("i % 3 <> 0").select("i", iso(5, "+01:00", "+02:00", "Z", "+15:00", "").alias("iso"), no_offset.alias("o")),
        e.where("i % 2 = 0").select("i", iso(3, "+01:00", "-05:30", "+02:00").alias("iso"), F.when(F.col("i") % 7 == 0, 60).alias("o")),
        e.where("i % 5 = 1").select("i", no_time.alias("iso"), F.when(F.col("i") % 2 == 0, 60).otherwise(-90).alias("o")),
    ]
    told = parts[0].union(parts[1]).union(parts[2]).union(parts[1]).select(F.col("i").alias("message_id"), F.col("iso").alias("local_iso"), F.col("o").alias("stated_offset_min"))
    out = canonical.merge_local_times(messages, told)
    listed = lambda f: F.array_join(F.try_element_at("conflicts", F.lit(f)), ",").alias(f"{f}_conflicts")
    return out.select("message_id", "timezone_offset_min", "local_iso", listed("timezone_offset_min"), listed("local_iso"), "failed")


QUERIES = {f.__name__: f for f in (incremental_resolution, staged_records, source_reconciliation, local_time_merge)}
ORACLES = {
    "incremental_resolution": identity.ORACLES["resolved_messages"],
    "local_time_merge": """WITH e AS (SELECT event_id AS i, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS t FROM events),
  b AS (SELECT i, t || (['+01:00', '-05:30', '+02:00'])[i % 3 + 1] AS iso, ([60, -330, 120])[i % 3 + 1] AS own, CASE WHEN i % 7 = 0 THEN 60 END AS o FROM e WHERE i % 2 = 0),
  s AS (SELECT i, t || (['+01:00', '+02:00', 'Z', '+15:00', ''])[i % 5 + 1] AS iso, ([60, 120, 0, 900, NULL])[i % 5 + 1] AS own, NULL::INT AS o FROM e WHERE i % 3 <> 0 UNION ALL SELECT * FROM b UNION ALL SELECT i, NULL, NULL, CASE WHEN i % 2 = 0 THEN 60 ELSE -90 END FROM e WHERE i % 5 = 1 UNION ALL SELECT * FROM b),
  k AS (SELECT *, (iso IS NULL OR (own IS NOT NULL AND abs(own) <= 840)) AND NOT (o IS NOT NULL AND own IS NOT NULL AND o <> own) AS ok, coalesce(o, own) AS z FROM s),
  m AS (SELECT i, CASE WHEN i % 4 = 0 THEN 60 END AS z, CASE WHEN i % 9 = 0 THEN t || '+01:00' END AS iso FROM e),
  f AS (SELECT m.i, coalesce(m.z, min(k.z) FILTER (k.ok)) AS z, coalesce(m.iso, min(k.iso) FILTER (k.ok)) AS iso, count(*) FILTER (NOT k.ok) AS failed FROM m LEFT JOIN k ON k.i = m.i GROUP BY m.i, m.z, m.iso)
  SELECT f.i AS message_id, any_value(f.z)::BIGINT AS timezone_offset_min, any_value(f.iso) AS local_iso, array_to_string(list_sort(list_distinct(list(k.z) FILTER (k.ok AND k.z <> f.z))), ',') AS timezone_offset_min_conflicts,
    array_to_string(list_sort(list_distinct(list(k.iso) FILTER (k.ok AND k.iso <> f.iso))), ',') AS local_iso_conflicts, any_value(f.failed) AS failed FROM f LEFT JOIN k ON k.i = f.i GROUP BY f.i""",
    "source_reconciliation": """WITH e AS (SELECT event_id AS i, user_id // 2 AS chat, event_id % 103 = 0 AS x, event_id % 97 <> 0 AND event_id % 103 <> 0 AS em, event_id % 77 <> 0 AND event_id % 83 <> 0 AND event_id % 91 <> 0 AS sound FROM events),
  r AS (SELECT *, (sound AND i % 107 <> 0) OR (NOT sound AND i % 71 <> 0) OR i % 109 = 0 AS has FROM e WHERE em UNION ALL SELECT *, (sound AND i % 107 <> 0) OR (NOT sound AND i % 71 <> 0) OR i % 109 = 0 FROM e WHERE em AND i % 101 = 0),
  l AS (SELECT i AS row_id, CASE WHEN i % 83 = 0 THEN -i - 1 WHEN i % 91 <> 0 THEN i END AS m, * FROM e WHERE i % 77 <> 0),
  a(table_name, row_id, message_id, other_id, outcome, reason) AS (
    SELECT 'message', i, i, NULL::BIGINT, CASE WHEN x THEN 'error' WHEN NOT em THEN 'lost' WHEN i % 101 = 0 THEN 'doubled' ELSE 'emitted' END, CASE WHEN x THEN NULL WHEN NOT em THEN 'MESSAGE_LOST' WHEN i % 101 = 0 THEN 'MESSAGE_TWICE' END FROM e
    UNION ALL SELECT 'chat_message_join', row_id, m, chat, CASE WHEN NOT sound THEN 'unsupported' WHEN em AND i % 107 <> 0 THEN 'emitted' WHEN x THEN 'error' ELSE 'lost' END, CASE WHEN i % 83 = 0 THEN 'MESSAGE_MISSING' WHEN i % 91 = 0 THEN 'ID_MISSING' WHEN x OR (em AND i % 107 <> 0) THEN NULL ELSE 'CONVERSATION_LOST' END FROM l
    UNION ALL SELECT 'chat_message_join', row_id + 1000000000, m, chat, CASE WHEN sound THEN 'duplicate' ELSE 'unsupported' END, CASE WHEN i % 83 = 0 THEN 'MESSAGE_MISSING' WHEN i % 91 = 0 THEN 'ID_MISSING' ELSE 'SAME_RELATION' END FROM l WHERE i % 50 = 0
    UNION ALL SELECT 'chat_message_join', NULL, i, -1, 'unfounded', 'CONVERSATION_WITHOUT_SOURCE' FROM e WHERE em AND i % 109 = 0
    UNION ALL SELECT 'orphan', NULL, i, NULL, CASE WHEN em AND i % 71 <> 0 THEN 'emitted' WHEN x THEN 'error' ELSE 'lost' END, CASE WHEN (em AND i % 71 <> 0) OR x THEN NULL ELSE 'ORPHAN_LOST' END FROM e WHERE NOT sound
    UNION ALL SELECT 'record', NULL, i, NULL, 'unfounded', 'PRIMARY_CONVERSATION_DIFFERS' FROM r WHERE has AND i % 113 = 0
    UNION ALL SELECT 'message_attachment_join', i, i, i, CASE WHEN i % 170 = 0 THEN 'unsupported' WHEN em AND i % 130 <> 0 THEN 'emitted' WHEN x THEN 'error' ELSE 'lost' END, CASE WHEN i % 170 = 0 THEN 'ATTACHMENT_MISSING' WHEN x OR (em AND i % 130 <> 0) THEN NULL ELSE 'ATTACHMENT_LOST' END FROM e WHERE i % 10 = 0
    UNION ALL SELECT 'message_attachment_join', NULL, i, i, 'unfounded', 'ATTACHMENT_WITHOUT_SOURCE' FROM e WHERE em AND i % 101 = 0 AND i % 10 = 0 AND i % 130 <> 0 AND i % 170 <> 0
    UNION ALL SELECT 'attachment', -i - 1, NULL, NULL, 'unsupported', 'NO_LINK' FROM e WHERE i % 190 = 0)
  SELECT * FROM a""",
    "staged_records": """WITH r AS (SELECT event_id::VARCHAR AS source_message_id, CASE WHEN event_id % 101 <> 0 THEN 'k' || event_id END AS source_record_key, event_type || ' č' || chr(10) || '"' || props AS text, value, event_id % 97 = 0 OR event_id % 89 = 0 OR event_id % 101 = 0 AS bad FROM events)
  SELECT source_message_id, source_record_key, CASE WHEN NOT bad THEN text END AS text, CASE WHEN NOT bad THEN value END AS value, CASE WHEN bad THEN 'ValueError' END AS error_type FROM r""",
}
