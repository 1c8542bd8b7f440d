from threadloom import streaming


def test_sessions_and_counts(spark, tmp_path):
    day = 86_400_000_000
    start = 365 * day
    rows = [(1, 1, 0, "a"), (1, 2, 10_000_000, "b"), (1, 1, 10 * 3600 * 1_000_000, "c"), (1, 1, None, "d"), (1, 1, 30 * day, "e"), (1, 2, 10_000_000, "b")]
    rows = [(c, s, t if t is None else t + start, k) for c, s, t, k in rows]
    schema = "conversation_id bigint, sender_id bigint, timestamp_us bigint, source_record_key string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))

    def run(build, name):
        q = build(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("append").format("memory").queryName(name).start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name).collect()

    assert sorted((r.message_count, r.start_us) for r in run(streaming.sessions, "s")) == [(1, start + 36_000_000_000), (3, start)]
    assert sorted((r.sender_id, r.message_count) for r in run(streaming.daily_counts, "d")) == [(1, 2), (2, 2)]
    assert len(run(streaming.first_records, "f")) == 4 and len(run(streaming.untimed, "u")) == 1
    seen = []
    q = streaming.recompute_changed(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), lambda ids, _: seen.extend(r.conversation_id for r in ids.collect())).start()
    q.processAllAvailable()
    q.stop()
    assert seen == [1]
