import itertools

from threadloom.operators.canonical import merge_local_times


def test_every_order_gives_one_result(spark):
    told = [(1, "2024-01-02T10:00:00+02:00", None), (1, None, 60), (1, "2024-01-02T09:00:00+01:00", 60), (1, "2024-01-02T08:00:00+01:00", 120), (1, "2024-01-02T08:00:00", None), (1, "2024-01-02T08:00:00+14:30", None), (1, None, 900), (2, "2024-01-02T10:00:00Z", None), (9, None, 60), (None, None, 60)]
    messages = spark.createDataFrame([(1, None, None, "x"), (2, 120, "kept", "y"), (3, None, None, "z")], "message_id bigint, timezone_offset_min int, local_iso string, failed string")
    seen = set()
    for order in itertools.islice(itertools.permutations(told), 0, None, 700_001):
        out = merge_local_times(messages, spark.createDataFrame(order, "message_id bigint, local_iso string, stated_offset_min int").repartition(3)).orderBy("message_id").collect()
        seen.add(tuple((r.message_id, r.timezone_offset_min, r.local_iso, tuple(sorted((k, tuple(v)) for k, v in (r.conflicts or {}).items())), r.failed) for r in out))
    assert seen == {(
        (1, 60, "2024-01-02T09:00:00+01:00", (("local_iso", ("2024-01-02T10:00:00+02:00",)), ("timezone_offset_min", ("120",))), 4),
        (2, 120, "kept", (("local_iso", ("2024-01-02T10:00:00Z",)), ("timezone_offset_min", ("0",))), 0),
        (3, None, None, (), 0),
    )}


def test_an_offset_is_read_once(spark):
    """However many columns name it: it was copied to each place, and each observation was read twice."""
    messages = spark.createDataFrame([(1, None, None)], "message_id bigint, timezone_offset_min int, local_iso string")
    told = spark.createDataFrame([(1, "2024-01-02T10:00:00+02:00", None)], "message_id bigint, local_iso string, stated_offset_min int")
    plan = merge_local_times(messages, told)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(") == 1
