"""What readers ask for: filters, overviews, pivots, evidence, windows of context."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HOUR = 3_600_000_000
DAY = 24 * HOUR
# Hours before and after an event that its context holds.
CONTEXT_WINDOWS = {"conflict": (24, 24), "change": (14 * 24, 7 * 24), "cycle": (14 * 24, 14 * 24), "longitudinal": (30 * 24, 30 * 24), "dynamics": (30 * 24, 30 * 24), "hypotheses": (30 * 24, 30 * 24), "segment": (24, 24)}


def message_filter(messages: DataFrame, start_us: int | None = None, end_us: int | None = None, senders: Sequence[int] | None = None, contains: str | None = None, keep_unknown_times: bool = True) -> DataFrame:
    """Unknown times stay unless told otherwise; an empty list of senders leaves no rows; the text is literal, case aside."""
    out = messages
    ts = F.col("timestamp_us")
    if start_us is not None or end_us is not None:
        within = (ts >= start_us if start_us is not None else F.lit(True)) & (ts <= end_us if end_us is not None else F.lit(True))
        out = out.where(within | ts.isNull() if keep_unknown_times else within & ts.isNotNull())
    if senders is not None:
        out = out.where(F.col("sender_id").isin(*senders) if senders else F.lit(False))
    if contains:
        out = out.where(F.lower("text").contains(contains.lower()))
    return out


def finding_filter(findings: DataFrame, start_us: int | None = None, end_us: int | None = None) -> DataFrame:
    """Findings whose interval overlaps; an unknown bound counts only where it is filtered by."""
    out = findings
    if start_us is not None:
        out = out.where(F.col("end_us") >= start_us)
    if end_us is not None:
        out = out.where(F.col("start_us") <= end_us)
    return out


def conversation_overview(messages: DataFrame, by: str = "conversation_id") -> DataFrame:
    return messages.groupBy(by).agg(F.count("*").alias("message_count"), F.count_distinct("sender_id").alias("sender_count"), F.count_if(F.col("timestamp_us").isNull()).alias("unknown_time_count"), F.min("timestamp_us").alias("first_us"), F.max("timestamp_us").alias("last_us"))


def inventory(messages: DataFrame, top: int = 100) -> DataFrame:
    """The conversations with most messages, with their senders."""
    per = messages.groupBy("conversation_id").agg(F.count("*").alias("message_count"), F.count_if(F.col("timestamp_us").isNull()).alias("unknown_time_count"), F.array_join(F.sort_array(F.collect_set("sender_id")), ",").alias("senders"))
    return per.orderBy(F.col("message_count").desc(), "conversation_id").limit(top)


def inventory_details(messages: DataFrame, memberships_of: DataFrame, sources: DataFrame, top: int = 100) -> DataFrame:
    """The conversations with most messages: participants (an array of id, name and is_self, by id) and sources (an array of
    type, snapshot and source conversation). memberships_of: conversation_id, participant_id, canonical_name, is_self; sources:
    conversation_id, source_type, source_snapshot_key, source_conversation_id."""
    per = messages.groupBy("conversation_id").agg(F.count("*").alias("message_count"), F.count_if(F.col("timestamp_us").isNull()).alias("unknown_time_count"), F.min("timestamp_us").alias("first_us"), F.max("timestamp_us").alias("last_us"))
    first = per.orderBy(F.col("message_count").desc(), "conversation_id").limit(top)
    nested = lambda rows, name, *columns: rows.join(F.broadcast(first.select("conversation_id")), "conversation_id", "left_semi").groupBy("conversation_id").agg(F.sort_array(F.collect_set(F.struct(*columns))).alias(name))
    people = nested(memberships_of, "participants", "participant_id", "canonical_name", "is_self")
    return first.join(people, "conversation_id", "left").join(nested(sources, "sources", "source_type", "source_snapshot_key", "source_conversation_id"), "conversation_id", "left")


def daily_pivot(daily: DataFrame, metrics: dict[str, bool], columns: int = 2) -> DataFrame:
    """Days as rows, and for each metric a column for each of a conversation's participants, by rank of id: <metric>_1 to
    <metric>_<columns>, and <metric>_more for all further ones. A metric that is True counts: it is summed, and 0 where
    there is none; any other is the first known value in order of the participants' ids."""
    rank = F.dense_rank().over(Window.partitionBy("conversation_id").orderBy("participant_id"))
    placed = daily.select("conversation_id", "participant_id", "period_start", *metrics, F.least(rank, F.lit(columns + 1)).alias("_rank"))
    values = []
    for m, counts in metrics.items():
        for i in range(1, columns + 2):
            own = F.when(F.col("_rank") == i, F.col(m))
            name = f"{m}_{i}" if i <= columns else f"{m}_more"
            values.append((F.coalesce(F.sum(own), F.lit(0)) if counts else F.min_by(own, F.when(own.isNotNull(), F.col("participant_id")))).alias(name))
    return placed.groupBy("conversation_id", "period_start").agg(*values)


def opposite_sender_gaps(messages: DataFrame, most_hours: int = 72) -> DataFrame:
    w = Window.partitionBy("conversation_id").orderBy("timestamp_us", "membership_id")
    rows = messages.where("timestamp_us IS NOT NULL").select("*", F.lag("sender_id").over(w).alias("_who"), F.lag("timestamp_us").over(w).alias("_us"))
    gap = F.col("timestamp_us") - F.col("_us")
    return rows.where((F.col("_who") != F.col("sender_id")) & gap.between(0, most_hours * HOUR)).select("conversation_id", "membership_id", "sender_id", F.col("_who").alias("previous_sender_id"), gap.alias("gap_us"))


def around_evidence(sequenced: DataFrame, evidence: DataFrame, radius: int = 3) -> DataFrame:
    """Messages within so many places of one that is evidence (conversation_id, message_id), by a window, not by a range join."""
    flags = sequenced.join(evidence.select("conversation_id", "message_id").distinct().withColumn("_hit", F.lit(1)), ["conversation_id", "message_id"], "left")
    w = Window.partitionBy("conversation_id").orderBy("sequence_number").rowsBetween(-radius, radius)
    return flags.withColumn("_near", F.max("_hit").over(w)).where("_near = 1").withColumn("is_evidence", F.col("_hit").isNotNull()).drop("_near", "_hit")


def context_window(messages: DataFrame, requests: DataFrame, blind: bool = False) -> DataFrame:
    """requests: request_id, conversation_id, analysis, start_us, end_us. Messages of known time in each request's window; blind
    ones don't look beyond its end."""
    before = F.create_map(*[F.lit(x) for k, (a, _) in CONTEXT_WINDOWS.items() for x in (k, a * HOUR)])
    after = F.create_map(*[F.lit(x) for k, (_, b) in CONTEXT_WINDOWS.items() for x in (k, b * HOUR)])
    r = requests.select("request_id", "conversation_id", (F.col("start_us") - F.element_at(before, F.col("analysis"))).alias("_lo"), (F.col("end_us") + (F.lit(0) if blind else F.element_at(after, F.col("analysis")))).alias("_hi"))
    # By conversation and week: a request meets the messages of its own weeks, not all of a conversation that everybody asks about.
    week = lambda c: F.floor(F.col(c) / (168 * HOUR))
    r = r.withColumn("_week", F.explode(F.sequence(week("_lo"), F.greatest(week("_lo"), week("_hi")))))
    dated = messages.withColumn("_week", week("timestamp_us"))
    return dated.join(r, ["conversation_id", "_week"]).where(F.col("timestamp_us").between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi", "_week")


def candidate_disposition(candidates: DataFrame) -> DataFrame:
    """By importance: analyze from 80, suggest from 60, else skip; an override decides where given."""
    i = F.col("importance")
    return candidates.withColumn("disposition", F.coalesce("override", F.when(i >= 80, "analyze").when(i >= 60, "suggest").otherwise("skip")))


def ai_candidates(conflicts: DataFrame, changes: DataFrame, signals: DataFrame, regimes: DataFrame, topics: DataFrame) -> DataFrame:
    """Five kinds in one schema with an importance: 100 x score, 20 x |z| within 60 and 100, 80 or 50, 85 or 50, 65."""
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    a = conflicts.select("conversation_id", F.lit("conflict").alias("kind"), "start_us", "end_us", (F.col("score") * 100).alias("importance"))
    b = changes.select("conversation_id", F.lit("change").alias("kind"), us("period_date").alias("start_us"), (us("period_date") + DAY - 1).alias("end_us"), F.greatest(F.lit(60.0), F.least(F.lit(100.0), F.abs("z_score") * 20)).alias("importance"))
    c = signals.select("conversation_id", F.lit("engagement").alias("kind"), us("period_start").alias("start_us"), (us("period_end") + DAY - 1).alias("end_us"), F.when(F.col("direction") != "stable", 80.0).otherwise(50.0).alias("importance"))
    d = regimes.select("conversation_id", F.lit("regime").alias("kind"), us("period_start").alias("start_us"), (us("period_end") + DAY - 1).alias("end_us"), F.when(F.col("regime_type") != "stable_or_mixed", 85.0).otherwise(50.0).alias("importance"))
    e = topics.select("conversation_id", F.lit("topic").alias("kind"), us("first_date").alias("start_us"), (us("last_date") + DAY - 1).alias("end_us"), F.lit(65.0).alias("importance"))
    out = a
    for x in (b, c, d, e):
        out = out.unionByName(x)
    return out


def merge_candidates(candidates: DataFrame, least: float = 0.7) -> DataFrame:
    """Folds candidates of a conversation and kind, by start, into the merged one before where they overlap by `least` of the
    shorter (a second at least). Candidates without a start or an end are in no result: nothing can be said of their overlap.

    The fold depends on what was merged, so that it runs in Python, over rows in order with one merged candidate in hand:
    nothing is gathered. Islands go to tasks of their own: what starts when all before it have ended joins none of them.
    """
    columns = ["conversation_id", "kind", "start_us", "end_us", "importance", "merged"]
    schema = pa.schema([("conversation_id", pa.int64()), ("kind", pa.string()), ("start_us", pa.int64()), ("end_us", pa.int64()), ("importance", pa.float64()), ("merged", pa.int64())])

    def higher(a: float | None, b: float | None) -> float | None:
        return b if a is None else a if b is None else max(a, b)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, m = None, None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                now = (r["conversation_id"], r["kind"], r["_island"])
                start, end = r["start_us"], r["end_us"]
                over = min(m["end_us"], end) - max(m["start_us"], start) if m and now == key else 0
                if over > 0 and over / min(max(m["end_us"] - m["start_us"], 1_000_000), max(end - start, 1_000_000)) >= least:
                    m |= {"end_us": max(m["end_us"], end), "importance": higher(m["importance"], r["importance"]), "merged": m["merged"] + 1}
                    continue
                if m:
                    out.append(m)
                key, m = now, {**{c: r[c] for c in columns[:-1]}, "merged": 1}
            yield pa.RecordBatch.from_pylist(out, schema=schema)
        if m:
            yield pa.RecordBatch.from_pylist([m], schema=schema)

    known = candidates.where("start_us IS NOT NULL AND end_us IS NOT NULL").select(F.col("conversation_id").cast("bigint").alias("conversation_id"), "kind", "start_us", "end_us", F.col("importance").cast("double").alias("importance"))
    w = Window.partitionBy("conversation_id", "kind").orderBy("start_us", "end_us", "importance")
    before = F.max("end_us").over(w.rowsBetween(Window.unboundedPreceding, -1))
    known = known.withColumn("_new", F.when(F.col("start_us") >= before, 1).otherwise(0)).withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    island = ["conversation_id", "kind", "_island"]
    ordered = known.drop("_new").repartition(*island).sortWithinPartitions(*island, "start_us", "end_us", "importance")
    return ordered.mapInArrow(fold, "conversation_id bigint, kind string, start_us bigint, end_us bigint, importance double, merged bigint")


def ordered_lookup(requests: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """requests: ordinal and key. Rows in the order asked for; missing ones stay, with found false."""
    there = rows.withColumn("_there", F.lit(True))
    return requests.join(there, key, "left").withColumn("found", F.coalesce("_there", F.lit(False))).drop("_there").orderBy("ordinal")


def reduce_context(messages: Iterator[dict] | list[dict], evidence: set[int], most: int = 180, radius: int = 3) -> list[dict]:
    """Of one window's messages (a bounded list on the driver): all evidence and its neighbours, both ends, and evenly spaced others up to most."""
    rows = list(messages)
    if len(rows) <= most:
        return rows
    keep = {0, len(rows) - 1}
    for i, r in enumerate(rows):
        if r["message_id"] in evidence:
            keep.update(range(max(0, i - radius), min(len(rows), i + radius + 1)))
    free = [i for i in range(len(rows)) if i not in keep]
    room = max(0, most - len(keep))
    if room and free:
        step = len(free) / room
        keep.update(free[int(k * step)] for k in range(min(room, len(free))))
    return [rows[i] for i in sorted(keep)]
