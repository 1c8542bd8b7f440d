"""Order, runs, sessions, turns, reply threads and duplicates of messages.

Messages have membership_id, message_id, conversation_id, sender_id, timestamp_us (UTC microseconds), text, source_order,
source_message_id and timezone_offset_min; a message may be a member of several conversations. All windows are over the
conversation, in the order of order_keys(), so that Spark plans one exchange and one sort for a chain of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions import text as tx
from .graph import components


def order_keys() -> list[Column]:
    """Known times first; ties by source order, source id, message and membership."""
    return [F.col("timestamp_us").asc_nulls_last(), F.col("source_order").asc_nulls_last(), F.coalesce(F.col("source_message_id"), F.lit("")), F.col("message_id"), F.col("membership_id")]


def _window():
    return Window.partitionBy("conversation_id").orderBy(*order_keys())


def sequence_numbers(messages: DataFrame) -> DataFrame:
    return messages.withColumn("sequence_number", F.row_number().over(_window()))


def structured(messages: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Adds sequence_number, run_no, session_no, seconds_since_previous and seconds_since_other.

    Runs are of one sender, null being a sender too, whatever the session; a session ends at a gap of more than
    session_gap_seconds, and a message of unknown time is one by itself. The latest message of another sender is the
    last one of the run before, since rows are in the order of time.
    """
    w = _window()
    by_sequence = Window.partitionBy("conversation_id").orderBy("sequence_number")
    ts, previous = F.col("timestamp_us"), F.lag("timestamp_us").over(w)
    first = F.row_number().over(w) == 1
    starts_run = F.when(first | ~F.col("sender_id").eqNullSafe(F.lag("sender_id").over(w)), 1).otherwise(0)
    gap = ts - previous
    starts_session = F.when(first | ts.isNull() | previous.isNull() | (gap > config.session_gap_seconds * 1_000_000), 1).otherwise(0)
    flagged = messages.select("*", F.row_number().over(w).alias("sequence_number"), starts_run.alias("_r"), starts_session.alias("_s"), previous.alias("_p"))
    numbered = flagged.select("*", F.sum("_r").over(by_sequence).alias("run_no"), F.sum("_s").over(by_sequence).alias("session_no"))
    # The last known time of all runs before this one.
    carried = numbered.withColumn("_before_run", F.when(F.col("_r") == 1, F.max("timestamp_us").over(by_sequence.rowsBetween(Window.unboundedPreceding, -1))))
    other = F.last("_before_run", ignorenulls=True).over(Window.partitionBy("conversation_id", "run_no").orderBy("sequence_number").rowsBetween(Window.unboundedPreceding, 0))
    return carried.select(
        *messages.columns, "sequence_number", "run_no", "session_no",
        ((ts - F.col("_p")) / 1_000_000).alias("seconds_since_previous"), ((ts - other) / 1_000_000).alias("seconds_since_other"),
    )


def calendar(messages: DataFrame) -> DataFrame:
    """UTC and local date, weekday (Monday 0) and hour; local ones only where the offset is known."""
    utc = F.timestamp_micros("timestamp_us")
    local = F.timestamp_micros(F.col("timestamp_us") + F.col("timezone_offset_min").cast("bigint") * 60_000_000)
    return messages.select(
        "*", F.to_date(utc).alias("utc_date"), F.weekday(utc).alias("utc_weekday"), F.hour(utc).alias("utc_hour"),
        F.to_date(local).alias("local_date"), F.weekday(local).alias("local_weekday"), F.hour(local).alias("local_hour"),
    )


def text_features(messages: DataFrame, config: Config = DEFAULT) -> DataFrame:
    c = F.col("text")
    return messages.select(
        "*", tx.word_count(c).alias("word_count"), tx.char_count(c).alias("char_count"), tx.line_count(c).alias("line_count"), tx.emoji_count(c).alias("emoji_count"),
        tx.count_of(c, "?").alias("question_count"), tx.count_of(c, "!").alias("exclamation_count"), tx.uppercase_ratio(c).alias("uppercase_ratio"), tx.has_url(c).alias("has_url"),
        tx.marker_hits(c, config.affection_markers).alias("affection_count"), tx.marker_hits(c, config.negative_markers).alias("negative_count"),
    )


def processed(messages: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """All derived columns of a message; period_date is the local date where known, else the UTC date."""
    return text_features(calendar(structured(messages, config)), config).withColumn("period_date", F.coalesce("local_date", "utc_date"))


def sender_runs(messages: DataFrame, config: Config = DEFAULT) -> DataFrame:
    return structured(messages, config).groupBy("conversation_id", "run_no").agg(
        F.any_value("sender_id").alias("sender_id"), F.count("*").alias("message_count"), F.min("sequence_number").alias("first_sequence"), F.max("sequence_number").alias("last_sequence"),
        F.min_by("timestamp_us", "sequence_number").alias("first_us"), F.max_by("timestamp_us", "sequence_number").alias("last_us"),
    )


def sessions(messages: DataFrame, config: Config = DEFAULT) -> DataFrame:
    return structured(messages, config).groupBy("conversation_id", "session_no").agg(
        F.count("*").alias("message_count"), F.min("sequence_number").alias("first_sequence"), F.max("sequence_number").alias("last_sequence"), F.min("timestamp_us").alias("start_us"),
        F.max("timestamp_us").alias("end_us"), F.count_distinct("sender_id").alias("senders"),
    )


def numbered_turns(processed_messages: DataFrame) -> DataFrame:
    """Messages with their turn_no, which counts from 1 in each conversation: islands of one sender within a session."""
    w = Window.partitionBy("conversation_id").orderBy("sequence_number")
    starts = F.when((F.row_number().over(w) == 1) | ~F.col("sender_id").eqNullSafe(F.lag("sender_id").over(w)) | (F.col("session_no") != F.lag("session_no").over(w)), 1).otherwise(0)
    return processed_messages.withColumn("_t", starts).withColumn("turn_no", F.sum("_t").over(w)).drop("_t")


def turn_texts(processed_messages: DataFrame) -> DataFrame:
    """conversation_id, turn_no and the texts of the turn's messages in their order, a line each; null and empty texts are left out."""
    rows = numbered_turns(processed_messages).select("conversation_id", "turn_no", "sequence_number", F.nullif("text", F.lit("")).alias("_text"))
    parts = F.transform(F.array_sort(F.collect_list(F.when(F.col("_text").isNotNull(), F.struct("sequence_number", "_text")))), lambda x: x["_text"])
    return rows.groupBy("conversation_id", "turn_no").agg(F.array_join(parts, "\n").alias("text"))


def turns(processed_messages: DataFrame) -> DataFrame:
    """A row for each turn with what is counted in it, and the ids of its messages."""
    return numbered_turns(processed_messages).groupBy("conversation_id", "turn_no").agg(
        F.any_value("session_no").alias("session_no"), F.any_value("sender_id").alias("participant_id"), F.count("*").alias("message_count"),
        F.min_by("timestamp_us", "sequence_number").alias("start_us"), F.max_by("timestamp_us", "sequence_number").alias("end_us"),
        F.min_by("period_date", "sequence_number").alias("period_date"),
        F.sum("word_count").alias("word_count"), F.sum("char_count").alias("char_count"), F.sum("question_count").alias("question_count"), F.sum("exclamation_count").alias("exclamation_count"),
        F.sum("affection_count").alias("affection_count"), F.sum("negative_count").alias("negative_count"),
        F.transform(F.array_sort(F.collect_list(F.struct("sequence_number", "message_id"))), lambda x: x.message_id).alias("message_ids"),
    )


def response_samples(turn_rows: DataFrame) -> DataFrame:
    """Neighbouring turns of two known senders in a session. The latency is null if a time is unknown or it were negative."""
    w = Window.partitionBy("conversation_id").orderBy("turn_no")
    before = lambda c: F.lag(c).over(w)
    latency = F.col("start_us") - F.col("_end")
    rows = turn_rows.select("*", before("participant_id").alias("_who"), before("session_no").alias("_session"), before("end_us").alias("_end"), before("word_count").alias("_words"))
    return rows.where("_session = session_no AND _who IS NOT NULL AND participant_id IS NOT NULL AND _who <> participant_id").select(
        "conversation_id", "session_no", "turn_no", F.col("participant_id").alias("responder_id"), F.col("_who").alias("from_id"), "period_date",
        F.when(latency >= 0, latency).alias("latency_us"), (F.col("word_count") / F.greatest(F.col("_words"), F.lit(1))).alias("effort_ratio"),
    )


def unanswered_turns(turn_rows: DataFrame) -> DataFrame:
    """Turns of known senders that no other known sender's turn follows in the session, found from the session's last ones."""
    w = Window.partitionBy("conversation_id", "session_no")
    last = F.max_by("participant_id", F.when(F.col("participant_id").isNotNull(), F.col("turn_no"))).over(w)
    rows = turn_rows.withColumn("_last", last)
    other = F.max(F.when(F.col("participant_id") != F.col("_last"), F.col("turn_no"))).over(w)
    return rows.withColumn("_other", other).where("participant_id = _last AND (_other IS NULL OR _other < turn_no)").drop("_last", "_other")


def duplicate_groups(messages: DataFrame, attachments: DataFrame) -> DataFrame:
    """Messages with what makes them equal beside conversation and sender: clean_text and attachment_keys, the sorted keys of
    all their attachments (message_id, attachment_key), empty if there are none."""
    keys = attachments.groupBy("message_id").agg(F.array_join(F.array_sort(F.collect_list("attachment_key")), "\u001f").alias("attachment_keys"))
    return messages.join(keys, "message_id", "left").withColumns({"clean_text": tx.clean_text(F.col("text")), "attachment_keys": F.coalesce("attachment_keys", F.lit(""))})


def duplicate_pairs(messages: DataFrame, config: Config = DEFAULT, same: tuple[str, ...] = ("text",)) -> DataFrame:
    """Pairs that may be one message: same source id among equal texts of a sender (each with the first), or neighbours in
    time within the tolerance; same names what equal texts are (with duplicate_groups: clean_text and attachment_keys). Messages are flagged, never dropped; pairs are as many as messages at most."""
    group = ["conversation_id", "sender_id", *same]
    by_source = Window.partitionBy(*group, "source_message_id").orderBy("message_id")
    again = messages.where("source_message_id IS NOT NULL").withColumn("_first", F.first("message_id").over(by_source)).where("message_id <> _first")
    exact = again.select(F.col("_first").alias("left_id"), F.col("message_id").alias("right_id"), F.lit("same_source_id").alias("kind"), F.lit(1.0).alias("confidence"))
    w = Window.partitionBy(*group).orderBy("timestamp_us", "message_id")
    near = messages.where("timestamp_us IS NOT NULL").select("*", F.lag("message_id").over(w).alias("_id"), F.lag("timestamp_us").over(w).alias("_us"), F.lag("source_message_id").over(w).alias("_source"))
    near = near.where((F.col("timestamp_us") - F.col("_us") <= config.duplicate_tolerance_seconds * 1_000_000) & (F.col("_id") != F.col("message_id")) & (F.col("_source").isNull() | ~F.col("_source").eqNullSafe(F.col("source_message_id"))))
    near = near.select(F.least("_id", "message_id").alias("left_id"), F.greatest("_id", "message_id").alias("right_id"), F.lit("near_in_time").alias("kind"), F.lit(0.8).alias("confidence"))
    return exact.union(near).distinct()


def reply_edges(relations: DataFrame, memberships: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """relations (source_message_id, target_message_id, relation_type) between memberships of one conversation."""
    m = memberships.select("membership_id", "message_id", "conversation_id")
    source = m.select(F.col("membership_id").alias("source_membership_id"), F.col("message_id").alias("source_message_id"), "conversation_id")
    target = m.select(F.col("membership_id").alias("target_membership_id"), F.col("message_id").alias("target_message_id"), F.col("conversation_id").alias("_c"))
    joined = relations.where(F.col("relation_type").isin(*config.reply_types)).join(source, "source_message_id").join(target, "target_message_id")
    return joined.where("conversation_id = _c AND source_membership_id <> target_membership_id").select("conversation_id", "source_membership_id", "target_membership_id").distinct()


def reply_threads(edges: DataFrame, structured_messages: DataFrame) -> DataFrame:
    """Members of each thread of two and more, by place in the conversation. The thread is named by its smallest membership;
    session_no is given only where all members share it."""
    of = components(edges.select(F.col("source_membership_id").alias("a"), F.col("target_membership_id").alias("b")))
    rows = structured_messages.select("membership_id", "conversation_id", "sequence_number", "session_no").join(of.select(F.col("node").alias("membership_id"), F.col("component").alias("thread_id")), "membership_id")
    whole = Window.partitionBy("thread_id")
    position = F.row_number().over(whole.orderBy("sequence_number"))
    session = F.when(F.min("session_no").over(whole) == F.max("session_no").over(whole), F.col("session_no"))
    return rows.select("conversation_id", "thread_id", "membership_id", position.alias("position"), session.alias("session_no"), F.count("*").over(whole).alias("size"))


def resolved_participants(participants: DataFrame) -> DataFrame:
    """participant_id, resolved_id, method: all that are explicitly the owner become the smallest of them."""
    own = participants.where("is_self").agg(F.min("participant_id").alias("_self"))
    merged = F.coalesce("is_self", F.lit(False)) & F.col("_self").isNotNull()
    return participants.crossJoin(F.broadcast(own)).select("participant_id", F.when(merged, F.col("_self")).otherwise(F.col("participant_id")).alias("resolved_id"), F.when(merged, "explicit_is_self_union").otherwise("identity").alias("method"))


def name_candidates(participants: DataFrame, normalize: bool = True) -> DataFrame:
    """Neighbours by id among equal names, not merged, only named as candidates."""
    rows = participants.join(resolved_participants(participants).select("participant_id", "resolved_id"), "participant_id").withColumn("_name", tx.person_name(F.col("canonical_name"), normalize)).where("_name IS NOT NULL")
    w = Window.partitionBy("_name").orderBy("participant_id")
    pairs = rows.select("participant_id", "resolved_id", F.lag("participant_id").over(w).alias("_left"), F.lag("resolved_id").over(w).alias("_resolved"))
    return pairs.where("_left IS NOT NULL AND _resolved <> resolved_id").select(F.col("_left").alias("left_id"), F.col("participant_id").alias("right_id"), F.lit(0.35).alias("confidence"))
