"""The second derivation against a plain loop over each conversation, and what it finds in altered results."""

import random

from pyspark.sql import functions as F

from threadloom.operators import behaviour as bh
from threadloom.operators import rederive as rd
from threadloom.operators import structure as st

MESSAGE = "membership_id long, message_id long, conversation_id long, sender_id long, timestamp_us long, text string, source_order long, source_message_id string, timezone_offset_min int"


def messages(spark, n=400, seed=1):
    r = random.Random(seed)
    rows = [(i, i, r.randrange(3), r.choice([1, 2, 2, 3, None]), None if r.random() < 0.05 else 1_700_000_000_000_000 + r.randrange(200) * 3_600_000_000, r.choice(["a b", "one!", "what? love you", "", None]), i, None, r.choice([None, 60, -600])) for i in range(n)]
    return spark.createDataFrame(rows, MESSAGE)


def published(m):
    p = st.processed(m).cache()
    t = st.turns(p).cache()
    r = st.response_samples(t).cache()
    return p, t, r, bh.participant_summary(p, t, r, st.unanswered_turns(t)), bh.conversation_summary(p, t)


def faults(*tables):
    return {x.code: x.n for x in rd.analytics_faults(*tables).where("n > 0").collect()}


def looped(rows):
    """(conversation, turn) to (session, sender, messages, words, start, end), by walking through the messages."""
    out = {}
    for row in sorted(rows, key=lambda x: (x.conversation_id, x.sequence_number)):
        key, last = (row.session_no, row.sender_id), None
        n = max((k[1] for k in out if k[0] == row.conversation_id), default=0)
        last = out.get((row.conversation_id, n))
        if last and last[0] == key:
            last[1].append(row)
        else:
            out[row.conversation_id, n + 1] = (key, [row])
    return {k: (*key, len(of), sum(x.word_count for x in of), of[0].timestamp_us, of[-1].timestamp_us) for k, (key, of) in out.items()}


def test_turns_equal_a_loop_for_any_size_of_blocks(spark, monkeypatch):
    p = st.processed(messages(spark)).cache()
    want = looped(p.collect())
    for block in (1, 3, 4096):
        monkeypatch.setattr(rd, "BLOCK", block)
        got = {(x.conversation_id, x.turn_no): (x.session_no, x.participant_id, x.message_count, x.word_count, x.start_us, x.end_us) for x in rd.turns_again(p).collect()}
        assert got == want, block


def test_nothing_is_found_in_right_results_and_empty_tables(spark):
    assert faults(*published(messages(spark))) == {}
    assert faults(*published(messages(spark).limit(0))) == {}


def test_each_altered_metric_is_named(spark):
    p, t, r, s, c = published(messages(spark, 120))
    s = s.cache()
    altered = ("active_days", "unanswered_turn_count", "p90_response_latency_seconds", "engagement_score")
    told = s.withColumns({m: F.col(m) + F.when(F.col("participant_id") == 2, 2e-6).otherwise(0.0) for m in altered})
    assert faults(p, t, r, told, c).keys() == {f"{m.upper()}_DIFFERS" for m in altered}
    assert faults(p, t, r, s.withColumn("p25_response_latency_seconds", F.lit(float("nan"))), c).keys() == {"P25_RESPONSE_LATENCY_SECONDS_DIFFERS"}


def test_order_of_ids_counts(spark):
    p, t, r, s, c = published(messages(spark, 120))
    assert list(faults(p, t.withColumn("message_ids", F.reverse("message_ids")), r, s, c)) == ["TURN_MESSAGES_DIFFER"]
    assert list(faults(p, t.withColumn("message_ids", F.transform("message_ids", lambda x: x + 1)), r, s, c)) == ["TURN_MESSAGES_DIFFER"]


def test_quantiles_by_rank(spark):
    rows = spark.createDataFrame([(1, float(v)) for v in (4, 1, 3, 2)] + [(2, 5.0), (2, None), (3, None)], "k long, v double")
    got = {x.k: (x.a, x.b, x.c) for x in rd.quantiles(rows, ["k"], "v", {"a": 0.5, "b": 0.25, "c": 1.0}).collect()}
    assert got == {1: (2.5, 1.75, 4.0), 2: (5.0, 5.0, 5.0)}


def test_digests_over_blocks_and_long_turns(spark, monkeypatch):
    long = [(i, i * 7, 1, 2 if i < 70_000 else 3, 1_700_000_000_000_000 + i * 1000, None, i, None, None) for i in range(70_010)]
    tables = published(spark.createDataFrame(long, MESSAGE))
    assert faults(*tables) == {}
    monkeypatch.setattr(rd, "BLOCK", 3)
    p, t, r, s, c = published(messages(spark, 120))
    assert faults(p, t, r, s, c) == {}
    assert list(faults(p, t.withColumn("message_ids", F.reverse("message_ids")), r, s, c)) == ["TURN_MESSAGES_DIFFER"]


def test_faults_are_planted_in_one_pass_over_the_rows(spark):
    from threadloom.plans import audits as au

    rows = spark.createDataFrame([(k, 10 * (k or 5)) for k in (0, 1, 2, 3, 4, 4, None)], "k long, v long").repartition(3)
    told = au._altered(rows, F.col("k"), {2: {"v": F.col("v") + 1}}, 0, 1, (3, {"k": F.col("k") + 100}))
    assert told.columns == ["k", "v"]
    assert sorted(map(tuple, told.collect()), key=str) == sorted([(1, 10), (1, 10), (2, 21), (3, 30), (103, 30), (4, 40), (4, 40)], key=str)
    assert told._jdf.queryExecution().optimizedPlan().toString().count("Repartition") == 1
