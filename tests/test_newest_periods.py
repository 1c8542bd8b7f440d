from oracle import SF
from pyspark.sql import Window
from pyspark.sql import functions as F

from threadloom.plans import adapters as ad
from threadloom.plans import trends
from threadloom.plans.trends import _series


def test_newest_periods_are_the_last_of_all(spark):
    """Slopes need the last few periods; the series of years was made for them and thrown away."""
    shown = ["conversation_id", "participant_id", "period_start", "message_count", "turn_count", "median_response_latency_seconds"]
    for kind, n in (("week", 8), ("month", 6)):
        every = _series(spark, SF, kind, ad.orders, ad.ORDERS)
        last = every.withColumn("n", F.row_number().over(Window.partitionBy("conversation_id", "participant_id").orderBy(F.col("period_start").desc()))).where(F.col("n") <= n)
        few = _series(spark, SF, kind, ad.orders, ad.ORDERS, n)
        want, got = last.select(*shown).collect(), few.select(*shown).collect()
        assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) < every.count()


def test_candidates_read_the_events_once(spark):
    """Messages, turns and signals are kept: the plan of what reads them has no more of the events."""
    plan = trends.findings_union(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "event_type#" not in plan and "props#" not in plan
