"""Turns, responses and summaries derived a second time and held against what was published.

Nothing here is shared with the operators that publish: the message before is found by an equi-join on dense sequence numbers
instead of a window over the conversation, turns are numbered by counts within blocks of BLOCK messages (windows of bounded
size, and one over the blocks), clocks are whole-number arithmetic, unanswered turns come from the last turns of a session's
two latest senders, and percentiles from ranks. No step needs a conversation in one place but that over its blocks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from . import views as vw
from .graph import checkpointed, kept

BLOCK = 4096
PRIME = 2**31 - 1
HOUR, DAY = 3_600_000_000, 86_400_000_000
DIGESTS = ("ids", "ids_low", "places")
QUANTILES = {"median_response_latency_seconds": 0.5, "p25_response_latency_seconds": 0.25, "p75_response_latency_seconds": 0.75, "p90_response_latency_seconds": 0.9}
#: The score is published to six digits.
HALF_DIGIT = 5.1e-7
METRICS = (
    "message_count", "word_count", "character_count", "active_days", "question_count", "exclamation_count", "affection_marker_count", "negative_marker_count", "clock_known_message_count", "weekend_message_count",
    "night_message_count", "turn_count", "initiations", "unanswered_turn_count", "response_turn_count", "latency_sample_count", "mean_response_latency_seconds", *QUANTILES, "median_response_effort_ratio", "initiation_share", "engagement_score",
)
CONVERSATION = ("message_count", "unknown_sender_count", "session_count", "turn_count")


def _ordered(position: Column, message_id: Column) -> dict[str, Column]:
    """What sums over a turn's messages are made of: halves of their ids' hashes, and hashes by position, modulo PRIME. Whole
    numbers below 2^32 each, so that no turn's sums leave 64 bits."""
    h, weight = F.xxhash64(message_id), _weight(message_id)
    return {"ids": F.shiftrightunsigned(h, 32), "ids_low": h.bitwiseAND(F.lit(0xFFFFFFFF)), "places": (position % PRIME) * weight % PRIME}


def _weight(message_id: Column) -> Column:
    return F.crc32(message_id.cast("string").cast("binary")) % PRIME


def turns_again(messages: DataFrame) -> DataFrame:
    """conversation_id, turn_no, session_no, participant_id, message_count, word_count, start_us, end_us and digests (DIGESTS) of
    the message ids in their order. messages: conversation_id, sequence_number (dense from 1), session_no, sender_id,
    timestamp_us, message_id, word_count."""
    before = messages.select("conversation_id", (F.col("sequence_number") + 1).alias("sequence_number"), F.col("session_no").alias("_session"), F.col("sender_id").alias("_sender"), F.lit(True).alias("_there"))
    starts = F.col("_there").isNull() | (F.col("_session") != F.col("session_no")) | ~F.col("_sender").eqNullSafe(F.col("sender_id"))
    rows = messages.join(before, ["conversation_id", "sequence_number"], "left").withColumns({"_starts": F.when(starts, 1).otherwise(0).cast("bigint"), "_block": F.floor(F.col("sequence_number") / BLOCK)})
    inside = Window.partitionBy("conversation_id", "_block").orderBy("sequence_number").rowsBetween(Window.unboundedPreceding, 0)
    digests = _ordered(F.col("sequence_number"), F.col("message_id"))
    parts = checkpointed(rows.withColumn("_k", F.sum("_starts").over(inside)).groupBy("conversation_id", "_block", "_k").agg(
        F.min("sequence_number").alias("_low"), F.max("sequence_number").alias("_high"), F.min("session_no").alias("session_no"), F.max("session_no").alias("_last_session"), F.min("sender_id").alias("participant_id"), F.count("*").alias("message_count"), F.sum("word_count").alias("word_count"),
        F.min_by("timestamp_us", "sequence_number").alias("start_us"), F.max_by("timestamp_us", "sequence_number").alias("end_us"), *[F.sum(c).alias(f"_{n}") for n, c in digests.items()], F.sum(_weight(F.col("message_id"))).alias("_weights"),
    ))
    blocks = parts.groupBy("conversation_id", "_block").agg(F.max("_k").alias("_n"))
    carried = blocks.select("conversation_id", "_block", F.coalesce(F.sum("_n").over(Window.partitionBy("conversation_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_carried"))
    whole = parts.join(carried, ["conversation_id", "_block"]).groupBy("conversation_id", (F.col("_carried") + F.col("_k")).alias("turn_no")).agg(
        F.min("session_no").alias("session_no"), F.min("participant_id").alias("participant_id"), F.sum("message_count").alias("message_count"), F.sum("word_count").alias("word_count"), F.min_by("start_us", "_low").alias("start_us"), F.max_by("end_us", "_low").alias("end_us"),
        F.sum("_ids").alias("ids"), F.sum("_ids_low").alias("ids_low"), F.pmod(F.sum("_places") - (F.min("_low") - 1) % PRIME * (F.sum("_weights") % PRIME), F.lit(PRIME)).alias("places"),
    )
    return whole


def digested(turns: DataFrame) -> DataFrame:
    """Published turns with the digests of their message_ids, whose arrays are read in place, once."""
    placed = F.transform("message_ids", lambda x, i: F.struct(*[c.alias(n) for n, c in _ordered((i + 1).cast("bigint"), x).items()]))
    of = F.aggregate(placed, F.struct(*[F.lit(0).cast("bigint").alias(n) for n in DIGESTS]), lambda acc, x: F.struct(*[(acc[n] + x[n]).alias(n) for n in DIGESTS]))
    told = turns.withColumn("_of", F.explode(F.array(of)))
    return told.select(*turns.columns, "_of.ids", "_of.ids_low", (F.col("_of.places") % PRIME).alias("places"))


def linked(turns: DataFrame) -> DataFrame:
    """Turns with _session, from_id, _end and _words of the turn one number lower; nulls if there is none."""
    before = turns.select("conversation_id", (F.col("turn_no") + 1).alias("turn_no"), F.col("session_no").alias("_session"), F.col("participant_id").alias("from_id"), F.col("end_us").alias("_end"), F.col("word_count").alias("_words"))
    return turns.select("conversation_id", "turn_no", "session_no", "participant_id", "start_us", "word_count").join(before, ["conversation_id", "turn_no"], "left")


def responses_again(links: DataFrame) -> DataFrame:
    """conversation_id, turn_no, session_no, responder_id, from_id, latency_us, effort_ratio of linked turns."""
    rows = links.where("session_no = _session AND participant_id <> from_id")
    latency = F.col("start_us") - F.col("_end")
    return rows.select("conversation_id", "turn_no", "session_no", F.col("participant_id").alias("responder_id"), "from_id", F.when(latency >= 0, latency).alias("latency_us"), (F.col("word_count") / F.when(F.col("_words") > 1, F.col("_words")).otherwise(1)).alias("effort_ratio"))


def quantiles(rows: DataFrame, keys: list[str], column: str, wanted: dict[str, float]) -> DataFrame:
    """Interpolated quantiles of a column by rank; nulls don't count, keys without a value have no row. Sorts spill, nothing is gathered."""
    whole = Window.partitionBy(*keys)
    ranked = rows.where(F.col(column).isNotNull()).select(*keys, F.col(column).cast("double").alias("_v"), (F.row_number().over(whole.orderBy(column)) - 1).alias("_k"), F.count("*").over(whole).alias("_n"))
    at = {name: (F.col("_n") - 1) * q for name, q in wanted.items()}
    low = {name: F.max(F.when(F.col("_k") == F.floor(p), F.col("_v"))) for name, p in at.items()}
    high = {name: F.max(F.when(F.col("_k") == F.least(F.floor(p) + 1, F.col("_n") - 1), F.col("_v"))) for name, p in at.items()}
    rest = {name: F.max(p - F.floor(p)) for name, p in at.items()}
    return ranked.groupBy(*keys).agg(*[(low[n] + (high[n] - low[n]) * rest[n]).alias(n) for n in wanted])


def unanswered_again(turns: DataFrame) -> DataFrame:
    """conversation_id, participant_id, unanswered_turn_count. Only the sender of a session's last known turn has any: those
    after the last turn of all others."""
    known = turns.where("participant_id IS NOT NULL")
    ends = known.groupBy("conversation_id", "session_no", "participant_id").agg(F.max("turn_no").alias("_end")).repartition("conversation_id", "session_no")
    last = ends.groupBy("conversation_id", "session_no").agg(F.max_by("participant_id", "_end").alias("_who"))
    others = ends.join(last, ["conversation_id", "session_no"]).where("participant_id <> _who").groupBy("conversation_id", "session_no").agg(F.max("_end").alias("_other"))
    of = last.join(others, ["conversation_id", "session_no"], "left").withColumnRenamed("_who", "participant_id")
    return known.join(of, ["conversation_id", "session_no", "participant_id"]).where("_other IS NULL OR turn_no > _other").groupBy("conversation_id", "participant_id").agg(F.count("*").alias("unanswered_turn_count"))


def summary_again(messages: DataFrame, links: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """All METRICS of each known participant of a conversation, links being the linked turns; the score isn't rounded. A session
    starts with a turn after one of another session or none. Besides what turns_again reads, messages have timezone_offset_min, char_count, question_count, exclamation_count, affection_count and negative_count."""
    keys = ["conversation_id", "participant_id"]
    clock = F.col("timestamp_us") + F.coalesce(F.col("timezone_offset_min"), F.lit(0)).cast("bigint") * 60_000_000
    day = F.floor(clock / F.lit(DAY))
    hour = F.floor(F.pmod(clock, F.lit(DAY)) / F.lit(HOUR))
    weekday = F.pmod(day + 3, F.lit(7))  # day 0 was a Thursday
    night = F.pmod(hour - config.night_start, F.lit(24)) < (config.night_end - config.night_start) % 24
    sums = {"word_count": "word_count", "character_count": "char_count", "question_count": "question_count", "exclamation_count": "exclamation_count", "affection_marker_count": "affection_count", "negative_marker_count": "negative_count"}
    counted = messages.where("sender_id IS NOT NULL").groupBy("conversation_id", F.col("sender_id").alias("participant_id")).agg(
        F.count("*").alias("message_count"), *[F.sum(c).alias(n) for n, c in sums.items()], F.count_distinct(day).alias("active_days"), F.count("timestamp_us").alias("clock_known_message_count"), F.count_if(weekday >= 5).alias("weekend_message_count"), F.count_if(night).alias("night_message_count"),
    )
    starts = F.when(F.col("_session").isNull() | (F.col("_session") != F.col("session_no")), 1)
    by_turn = links.groupBy(*keys).agg(F.count("*").alias("turn_count"), F.count(starts).alias("initiations"))
    answers = responses_again(links).withColumnRenamed("responder_id", "participant_id")
    by_answer = answers.groupBy(*keys).agg(F.count("*").alias("response_turn_count"), F.count("latency_us").alias("latency_sample_count"), (F.avg("latency_us") / 1_000_000).alias("mean_response_latency_seconds"))
    late = quantiles(answers, keys, "latency_us", QUANTILES).withColumns({n: F.col(n) / 1_000_000 for n in QUANTILES})
    effort = quantiles(answers, keys, "effort_ratio", {"median_response_effort_ratio": 0.5})
    rows = reduce(lambda x, y: x.join(y, keys, "left"), [by_turn, unanswered_again(links), by_answer, late, effort], counted)
    rows = rows.fillna(0, ["turn_count", "initiations", "unanswered_turn_count", "response_turn_count", "latency_sample_count"])
    whole = rows.groupBy("conversation_id").agg(F.sum("initiations").alias("_all_starts"), F.sum("turn_count").alias("_all_turns"))
    over = lambda a, b: F.col(a) / F.when(F.col(b) > 1, F.col(b)).otherwise(1)
    within = lambda c: F.when(c < 0, 0.0).when(c > 1, 1.0).otherwise(c)
    prompt = F.when(F.col("latency_sample_count") == 0, 0.0).otherwise(1 - within(F.col("median_response_latency_seconds") / config.responsiveness_seconds))
    parts = [over("turn_count", "_all_turns"), over("initiations", "_all_starts"), prompt, within(over("question_count", "turn_count")), within(over("affection_marker_count", "turn_count"))]
    score = reduce(lambda x, y: x + y, [100 * w * c for w, c in zip(config.engagement_weights, parts, strict=True)])
    return rows.join(whole, "conversation_id").withColumns({"initiation_share": parts[1], "engagement_score": score}).select(*keys, *METRICS)


def conversations_again(messages: DataFrame, turns: DataFrame) -> DataFrame:
    counted = messages.groupBy("conversation_id").agg(F.count("*").alias("message_count"), F.count_if(F.col("sender_id").isNull()).alias("unknown_sender_count"), F.count_distinct("session_no").alias("session_count"))
    return counted.join(turns.groupBy("conversation_id").agg(F.max("turn_no").alias("turn_count")), "conversation_id")


def _held(told: DataFrame, again: DataFrame, keys: list[str], name: str, differ: dict[str, tuple[list[str], float | None]]) -> list[DataFrame]:
    """Codes of rows that one side lacks, that are told twice, and of columns that differ: in anything, or by more than a tolerance."""
    columns = [c for cs, _ in differ.values() for c in cs]
    b = again.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_b"))
    a = told.select(*keys, *columns).groupBy(*keys).agg(F.count("*").alias("_times"), *[F.min(c).alias(c) for c in columns])
    both = a.join(b, keys, "full")

    def off(c: str, tolerance: float | None) -> Column:
        x, y = F.col(c), F.col(f"_{c}")
        return ~x.eqNullSafe(y) if tolerance is None else F.when(x.isNull() | y.isNull(), ~x.eqNullSafe(y)).otherwise(F.isnan(x.cast("double")) | (F.abs(x - y) > tolerance))

    paired = (F.col("_times") == 1) & F.col("_b")
    counts = {f"{name}_MISSING": F.col("_times").isNull(), f"{name}_UNEXPECTED": F.col("_b").isNull(), f"{name}_REPEATED": F.col("_times") > 1}
    counts |= {code: paired & reduce(lambda x, y: x | y, [off(c, t) for c in cs]) for code, (cs, t) in differ.items()}
    per = both.agg(*[F.count_if(c).alias(code) for code, c in counts.items()])
    return [per.select(F.explode(F.array(*[F.struct(F.lit(code).alias("code"), F.col(code).alias("n")) for code in counts])).alias("c")).select("c.code", "c.n")]


def analytics_faults(messages: DataFrame, turns: DataFrame, responses: DataFrame, summary: DataFrame, conversations: DataFrame, config: Config = DEFAULT, tolerance: float = 1e-9) -> DataFrame:
    """Published turns, responses, summaries of participants and of conversations against their second derivation from the
    messages: (code, n, severity). Whole numbers and ids must be equal, other metrics within the tolerance, a null only to a
    null; the score within half of its last digit. A row told twice has that fault alone."""
    again = checkpointed(turns_again(messages))
    links = kept(linked(again))
    exact = {m: None for m in METRICS} | {m: tolerance for m in METRICS if m.endswith(("_seconds", "_ratio", "_share"))} | {"engagement_score": HALF_DIGIT}
    at = ["conversation_id", "turn_no"]
    return vw.issues(
        *_held(digested(turns), again, at, "TURN", {"TURN_SESSION_DIFFERS": (["session_no"], None), "TURN_SENDER_DIFFERS": (["participant_id"], None), "TURN_TIME_DIFFERS": (["start_us", "end_us"], None), "TURN_COUNT_DIFFERS": (["message_count", "word_count"], None), "TURN_MESSAGES_DIFFER": (list(DIGESTS), None)}),
        *_held(responses, responses_again(links), at, "RESPONSE", {"RESPONSE_PARTIES_DIFFER": (["session_no", "responder_id", "from_id"], None), "LATENCY_DIFFERS": (["latency_us"], None), "EFFORT_DIFFERS": (["effort_ratio"], tolerance)}),
        *_held(summary, summary_again(messages, links, config), ["conversation_id", "participant_id"], "PARTICIPANT", {f"{m.upper()}_DIFFERS": ([m], exact[m]) for m in METRICS}),
        *_held(conversations, conversations_again(messages, links), ["conversation_id"], "CONVERSATION", {f"CONVERSATION_{m.upper()}_DIFFERS": ([m], None) for m in CONVERSATION}),
    )
