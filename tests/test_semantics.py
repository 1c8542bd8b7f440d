"""Literal cases: nulls, boundaries, order of input."""

import pytest
from pyspark.sql import functions as F

from threadloom.config import Config
from threadloom.functions import body
from threadloom.functions import text as tx
from threadloom.operators import behaviour as bh
from threadloom.operators import canonical as ca
from threadloom.operators import readers as rd
from threadloom.operators import series as se
from threadloom.operators import structure as st
from threadloom.operators import views as vw

S = 1_000_000
SCHEMA = "membership_id bigint, message_id bigint, conversation_id bigint, sender_id bigint, timestamp_us bigint, text string, source_order bigint, source_message_id string, timezone_offset_min int"


def messages(spark, rows):
    """(sender, seconds, text) in order."""
    return spark.createDataFrame([(i, i, 10, s, None if t is None else int(t * S), x, i, f"s{i}", None) for i, (s, t, x) in enumerate(rows, 1)], SCHEMA)


def chain(spark, rows, config=Config()):
    p = st.processed(messages(spark, rows), config)
    t = st.turns(p)
    return p, t, st.response_samples(t)


def test_latencies(spark):
    rows, t = [], 0
    for gap in (10, 20, 30, 40):
        rows += [(1, t, "a"), (2, t + gap, "b")]
        t += gap + 100
    rows.append((1, t, "a"))
    p, turns, r = chain(spark, rows)
    out = {x.participant_id: x for x in bh.participant_summary(p, turns, r, st.unanswered_turns(turns)).collect()}
    two = out[2]
    assert (two.mean_response_latency_seconds, two.median_response_latency_seconds, two.p25_response_latency_seconds, two.p75_response_latency_seconds) == (25, 25, 17.5, 32.5)
    assert two.p90_response_latency_seconds == pytest.approx(37.0)
    assert (out[1].unanswered_turn_count, two.unanswered_turn_count) == (1, 0)


def test_unknown_times(spark):
    _, turns, r = chain(spark, [(1, None, "one two"), (2, None, "x")])
    assert turns.count() == 2 and r.count() == 0  # each message of unknown time is a session by itself


def test_sessions_and_runs(spark):
    rows = [(1, 0, "a"), (1, 1, "a"), (2, 2, "b"), (2, 3, "b"), (1, 3 + 7 * 3600, "c"), (1, None, "d")]
    s = st.structured(messages(spark, rows)).orderBy("sequence_number").collect()
    assert [x.session_no for x in s] == [1, 1, 1, 1, 2, 3] and [x.run_no for x in s] == [1, 1, 2, 2, 3, 3]
    assert s[2].seconds_since_other == 1.0 and s[5].seconds_since_previous is None


def test_gap_of_exactly_the_limit(spark):
    s = st.structured(messages(spark, [(1, 0, "a"), (1, 6 * 3600, "b")])).collect()
    assert {x.session_no for x in s} == {1}


def test_order_of_input(spark):
    m = messages(spark, [(1, 5, "a"), (None, None, "b"), (2, 3, "c"), (None, 4, None)])
    a = sorted(map(tuple, st.processed(m).collect()), key=repr)
    b = sorted(map(tuple, st.processed(m.orderBy(F.col("message_id").desc())).collect()), key=repr)
    assert a == b


def test_unknown_first_sender_starts_nothing(spark):
    _, turns, _ = chain(spark, [(None, 0, "a"), (1, 1, "b")])
    assert bh.initiations(turns).count() == 0


def test_silence(spark):
    _, turns, _ = chain(spark, [(1, 0, "a"), (2, 10, "b"), (1, 90_010, "c")])
    e = bh.silence_events(turns).collect()
    assert [(x.gap_us // S, x.before_participant_id, x.return_participant_id, x.source_message_ids) for x in e] == [(90_000, 2, 1, [2, 3])]


def test_days_without_messages_and_change_point(spark):
    rows = [(1, d * 86400, "x") for d in range(7)] + [(1, 7 * 86400 + i, "x") for i in range(6)]
    p, t, r = chain(spark, rows)
    daily = se.series(p, t, r, "day")
    changes = [x for x in se.change_points(daily).collect() if x.metric == "message_count"]
    assert [(x.baseline, x.value, x.direction) for x in changes] == [(1, 6, "increasing")]
    p, t, r = chain(spark, [(1, 0, "x"), (1, 2 * 86400, "x")])
    assert [x.message_count for x in se.series(p, t, r, "day").orderBy("period_start").collect()] == [1, 0, 1]


def test_repeated_messages_make_no_pairs_of_all(spark):
    m = messages(spark, [(1, 10 * i, "same") for i in range(3000)])
    assert st.duplicate_pairs(m).count() == 0


def test_clean_text(spark):
    row = spark.createDataFrame([("  AHOJ!!! ❤️\r\nCo???   \x00",), (None,)], "t string").select(tx.clean_text(F.col("t")).alias("c"), tx.nfkc(F.col("t")).alias("k"), tx.word_count(F.col("t")).alias("w")).collect()
    assert row[0].c == "AHOJ!!! ❤️\nCo???" and row[1].c is None and row[1].w == 0
    assert spark.createDataFrame([("ﬁ é x",)], "t string").select(tx.nfkc(F.col("t"))).first()[0] == "fi é x"


def test_components_of_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101), (101, 100)], "a bigint, b bigint")
    out = {r.node: r.component for r in st.components(edges).collect()}
    assert len(out) == 62 and {out[i] for i in range(1, 61)} == {1} and out[101] == 100


def test_dense_ids(spark):
    ids = ca.dense_ids(spark.range(100).select((99 - F.col("id")).alias("v")), ["v"], "i", 7).orderBy("v").collect()
    assert [x.i for x in ids] == list(range(1, 101))


def test_messages_resolve_over_both_rules(spark):
    rows = [(1, "a", "k1", "sms", "g1"), (2, "a", "k2", "sms", "g1"), (3, "a", "k2", None, None), (4, "a", "k4", None, "g1"), (5, "b", "k1", None, None)]
    out = {r.source_pk: r.canonical_id for r in ca.resolve_messages(spark.createDataFrame(rows, "source_pk bigint, source_type string, source_record_key string, service string, guid string")).collect()}
    assert out == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}


def test_fingerprints_see_every_change(spark):
    m = messages(spark, [(1, 0, "a"), (2, 1, "b")])
    c = ["message_id", "sender_id", "text"]
    one = vw.fingerprints(m, c).first().fingerprint
    assert one == vw.fingerprints(m.orderBy(F.col("message_id").desc()), c).first().fingerprint
    assert one != vw.fingerprints(m.withColumn("text", F.when(F.col("message_id") == 1, None).otherwise(F.col("text"))), c).first().fingerprint


def test_merged_candidates(spark):
    rows = [(1, "x", 0, 100 * S, 10.0), (1, "x", 20 * S, 110 * S, 30.0), (1, "x", 105 * S, 300 * S, 20.0), (2, "x", None, 5, 1.0)]
    out = rd.merge_candidates(spark.createDataFrame(rows, "conversation_id bigint, kind string, start_us bigint, end_us bigint, importance double")).orderBy("start_us").collect()
    assert [(x.start_us // S, x.end_us // S, x.importance, x.merged) for x in out] == [(0, 110, 30.0, 2), (105, 300, 20.0, 1)]


def test_reduced_context():
    rows = [{"message_id": i} for i in range(1000)]
    out = [r["message_id"] for r in rd.reduce_context(rows, {500}, 180, 3)]
    assert len(out) <= 180 and {0, 999, *range(497, 504)} <= set(out) and out == sorted(out)


def test_empty_tables(spark):
    m = spark.createDataFrame([], SCHEMA)
    p = st.processed(m)
    t = st.turns(p)
    r = st.response_samples(t)
    assert bh.participant_summary(p, t, r, st.unanswered_turns(t)).count() == 0 and se.series(p, t, r, "week").count() == 0 and st.duplicate_pairs(m).count() == 0


def test_filter(spark):
    m = messages(spark, [(1, 1, "Hello"), (2, None, "hello"), (3, 9, "x")])
    assert rd.message_filter(m, 0, 5 * S).count() == 2 and rd.message_filter(m, senders=[]).count() == 0 and rd.message_filter(m, contains="HELLO").count() == 2


def test_body():
    text = "Žluť ❤".encode()
    assert body.decode(b"..NSString\x01\x94\x84\x01+" + bytes([len(text)]) + text + b"\x86") == "Žluť ❤"
    assert body.decode(b"nothing") is None and body.decode(None) is None and body.decode(b"NSString+\xff") is None


def test_config():
    with pytest.raises(ValueError):
        Config(engagement_weights=(1, 1, 0, 0, 0))
