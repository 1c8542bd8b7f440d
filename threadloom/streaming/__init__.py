"""Messages as they come: deduplicated records, sessions, daily counts, conversations to recompute."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config


def timed(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """Messages of known time with event_time and a watermark; those of unknown time are for `untimed`."""
    return stream.where("timestamp_us IS NOT NULL").withColumn("event_time", F.timestamp_micros("timestamp_us")).withWatermark("event_time", delay)


def untimed(stream: DataFrame) -> DataFrame:
    return stream.where("timestamp_us IS NULL")


def first_records(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """Each source_record_key once within the watermark."""
    return timed(stream, delay).dropDuplicatesWithinWatermark(["source_record_key"])


def sessions(stream: DataFrame, config: Config = DEFAULT, delay: str = "1 day") -> DataFrame:
    """Sessions of conversations. A gap of exactly the limit goes on with the session, as in a batch; a microsecond more ends it."""
    gap = f"{config.session_gap_seconds} seconds"
    per = timed(stream, delay).groupBy("conversation_id", F.session_window("event_time", gap).alias("w")).agg(F.count("*").alias("message_count"), F.min("timestamp_us").alias("start_us"), F.max("timestamp_us").alias("end_us"))
    return per.select("conversation_id", "message_count", "start_us", "end_us")


def daily_counts(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    per = timed(stream, delay).groupBy(F.window("event_time", "1 day").alias("w"), "conversation_id", "sender_id").agg(F.count("*").alias("message_count"))
    return per.select(F.to_date("w.start").alias("day"), "conversation_id", "sender_id", "message_count")


def recompute_changed(stream: DataFrame, recompute: Callable[[DataFrame, int], None]):
    """A writer that hands each batch's conversations (distinct ids) to recompute, once a batch."""
    return stream.writeStream.outputMode("append").foreachBatch(lambda batch, epoch: recompute(batch.select("conversation_id").distinct(), epoch))
