"""Topics: n-grams are counted where they arise, and large conversations are dealt over tasks with the same result."""

import datetime

import __spark_entry__
from oracle import SF
from pyspark.sql import functions as F

from threadloom.config import Config
from threadloom.operators import topics as tp

CONFIG = Config(topic_min_df=2)
DAY = datetime.date(2024, 1, 1)
# Message 3 is there twice with two senders, conversation 2 has one of no sender, conversation 3 no text.
ROWS = [
    (1, 1, 1, DAY, "red apple pie, red apple"), (1, 2, 2, DAY, "red apple"), (1, 3, 1, None, "apple pie"), (1, 3, 2, DAY, "apple pie red"), (1, 4, 1, DAY, "the ..."), (1, 5, 1, DAY, None),
    (2, 6, None, DAY, "blue sea and sky"), (2, 7, None, DAY, "blue sea"), (2, 8, 3, DAY, ""), (3, 9, 1, DAY, None), (None, 10, 1, DAY, "red apple"), (None, 11, 1, DAY, "red apple"),
]


def _messages(spark):
    return spark.createDataFrame(ROWS, "conversation_id bigint, message_id bigint, sender_id bigint, period_date date, text string")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_large_conversations_have_the_same_topics(spark):
    p = _messages(spark)
    found = [sorted(map(tuple, tp.topic_candidates(p, CONFIG, most=most).collect())) for most in (1, 30, 1 << 20)]
    assert found[0] == found[1] == found[2]
    of = {(r[0], r[3]): r[4:10] for r in found[0]}
    assert of[1, "apple"] == (3, 5, 2, DAY, DAY, 4) and of[1, "red apple"] == (2, 3, 2, DAY, DAY, 4) and of[2, "blue sea"] == (2, 2, 0, DAY, DAY, 2)
    assert not [k for k in of if k[0] not in (1, 2)]


def test_large_conversations_have_the_same_evidence(spark):
    p = _messages(spark)
    topics = tp.topic_candidates(p, CONFIG)
    want = tp.phrase_counts(p, CONFIG).join(topics.select("conversation_id", "n", "phrase"), ["conversation_id", "n", "phrase"])
    for most in (1, 30, 1 << 20):
        assert sorted(map(str, tp.topic_evidence(p, topics, CONFIG, most=most).select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_ngrams_are_not_shuffled(spark):
    df = tp.topic_candidates(_messages(spark).where("message_id <> 3"), CONFIG)
    assert df.count() and df.collect()
    plan = _plan(df).split("Initial Plan")[0]
    assert "isFinalPlan=true" in plan and "Expand" not in plan and not [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "phrase" in line]


def test_evidence_is_found_once(spark):
    for name in ("topic_period_recon", "marker_periods", "marker_recon"):
        df = __spark_entry__.queries()[name](spark, SF)
        assert "regexp_extract_all" not in _plan(df.select(F.lit(1))), name
