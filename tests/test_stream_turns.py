"""Turns of a stream against those of a batch."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from threadloom import streaming
from threadloom.config import DEFAULT
from threadloom.operators import structure
from threadloom.streaming import turns as st

SCHEMA = "conversation_id bigint, membership_id bigint, message_id bigint, sender_id bigint, timestamp_us bigint, source_order bigint, text string, timezone_offset_min int, source_message_id string"
DAY, MINUTE = 86_400_000_000, 60_000_000
START = 20_000 * DAY
CONFIG = replace(DEFAULT, session_gap_seconds=3600)


def messages(seed, n=120, conversations=4):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        t = START + rng.randrange(3 * DAY // MINUTE) * MINUTE // rng.choice([1, 1, 7])
        out.append((rng.randrange(conversations), i, i + 2**60, rng.choice([2**60 + 1, 2**60 + 2, None]), t, i if rng.random() < 0.8 else None, rng.choice(["Hi?", "no!", "a b c", None]), rng.choice([60, None]), None))
    # Ties in time, a gap of exactly the limit, and one that is a microsecond longer.
    t = START + 4 * DAY
    return out + [(9, 900, 900, 1, t, 1, "x", None, None), (9, 901, 901, 1, t, 0, "y", None, None), (9, 902, 902, 1, t + 3600 * 1_000_000, 0, "z", None, None), (9, 903, 903, 1, t + 7200 * 1_000_000 + 1, 0, "w", None, None)]


def end(t):
    """A message of another conversation that moves the watermark."""
    return [(-1, 10**6 + t % 1000, 10**6 + t % 1000, 1, t, 0, "end", None, None)]


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    st.with_rocksdb(spark)
    yield spark
    spark.conf.set(key, before) if before else spark.conf.unset(key)


def run(spark, folder, parts, delay="10 days"):
    """Each part is a file and a batch; the query is stopped and started again from its checkpoint between them."""
    out = []
    for i, part in enumerate(parts):
        # Names give the order of files.
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").json(f"{folder}/in/part-{i:03d}")
        stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").json(f"{folder}/in")
        q = st.turns(stream, CONFIG, delay).writeStream.foreachBatch(lambda b, _: out.extend(b.collect())).option("checkpointLocation", f"{folder}/check").trigger(availableNow=True).start()
        q.awaitTermination()
    return out


def key(r):
    return tuple(tuple(v) if isinstance(v, list) else v for v in r)


COLUMNS = ["conversation_id", "turn_no", "session_no", "participant_id", "message_count", "start_us", "end_us", "period_date", *st.COUNTS, "message_ids"]


def batch(spark, rows):
    return {key(r) for r in structure.turns(structure.processed(spark.createDataFrame(rows, SCHEMA), CONFIG)).select(*COLUMNS).collect()}


def closed(out):
    return {key([r[c] for c in COLUMNS]) for r in out if r.kind == "turn" and r.conversation_id >= 0}


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_equals_the_batch(rocks, tmp_path, seed):
    rows = messages(seed)
    shuffled = random.Random(seed).sample(rows, len(rows))
    parts = [shuffled[:50], shuffled[50:90], shuffled[90:], end(START + 40 * DAY), end(START + 80 * DAY)]
    out = run(rocks, tmp_path, parts)
    assert closed(out) == batch(rocks, rows)
    assert not [r for r in out if r.kind == "late"] and len(closed(out)) == len([r for r in out if r.conversation_id >= 0])


def test_turns_close_as_time_goes_by(rocks, tmp_path):
    """In order of time, with a short watermark: most turns are out before the end, and none twice."""
    rows = sorted(messages(3), key=lambda r: r[4])
    parts = [rows[:60], rows[60:100], rows[100:], end(START + 40 * DAY)]
    out = run(rocks, tmp_path, parts, "1 hour")
    assert closed(out) == batch(rocks, rows)
    assert len([r for r in out if r.kind == "turn" and r.conversation_id >= 0]) == len(closed(out))


def test_late_messages_come_out_as_they_are(rocks, tmp_path):
    t = START
    row = lambda i, at, sender=1: (1, i, i, sender, at, 0, "hi!", None, None)
    good = [row(1, t), row(2, t + MINUTE), row(3, t + 5 * DAY, 2)]
    parts = [good[:2], end(t + 2 * DAY), [row(50, t + MINUTE // 2, 2)], good[2:] + end(t + 3 * DAY), end(t + 50 * DAY)]
    out = run(rocks, tmp_path, parts, "1 minute")
    assert closed(out) == batch(rocks, good)
    late = [r for r in out if r.kind == "late" and r.conversation_id >= 0]
    assert [(r.message_ids, r.start_us, r.participant_id, r.exclamation_count, r.turn_no) for r in late] == [([50], t + MINUTE // 2, 2, 1, None)]


def test_equal_gap_of_sessions(spark, tmp_path):
    """A gap of exactly the limit goes on, a microsecond more does not: in the stream as in the batch."""
    gap = CONFIG.session_gap_seconds * 1_000_000
    times = [0, gap, 2 * gap + 1, 3 * gap + 2]
    rows = [(1, i, i, 1, START + t, i, "x", None, None) for i, t in enumerate(times)]
    spark.createDataFrame([*rows, (2, 99, 99, 1, START + 30 * DAY, 0, "end", None, None)], SCHEMA).coalesce(1).write.json(str(tmp_path / "in"))
    q = streaming.sessions(spark.readStream.schema(SCHEMA).json(str(tmp_path / "in")), CONFIG).writeStream.outputMode("append").format("memory").queryName("equal_gap").start()
    q.processAllAvailable()
    q.stop()
    want = {(r.message_count, r.start_us, r.end_us) for r in structure.sessions(spark.createDataFrame(rows, SCHEMA), CONFIG).collect()}
    assert {(r.message_count, r.start_us, r.end_us) for r in spark.table("equal_gap").where("conversation_id = 1").collect()} == want
    assert len(want) == 3
    assert spark.table("equal_gap").agg(F.sum("message_count")).first()[0] >= 4
