"""Runs are published whole or not at all, and messages resolve alike however they are imported."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from threadloom.operators import canonical, incremental
from threadloom.sources.publication import Publication


def rows(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "id bigint")


def ids(store, run_id=None):
    return sorted(r.id for r in store.read("rows", "id bigint", run_id).collect())


def statuses(store):
    return {r.run_id: (r.fingerprint, r.status, r.rows) for r in store.runs().collect()}


def test_runs_are_published_whole(spark, tmp_path):
    store = Publication(spark, f"file://{tmp_path}/p")
    assert ids(store) == [] and store.latest() is None and store.runs().count() == 0
    with pytest.raises(ValueError):
        store.read("rows")
    assert store.publish("a", {"rows": rows(spark, 1, 2)}) == 1
    assert store.publish("b", {"rows": rows(spark, 3), "more": rows(spark)}) == 2
    assert store.publish("a", {"rows": rows(spark, 9)}) == 1  # completed: nothing is done
    assert ids(store) == [1, 2, 3] and ids(store, 2) == [3] and store.read("more", "id bigint").count() == 0
    assert statuses(store) == {1: ("a", "completed", 2), 2: ("b", "completed", 1)}
    assert {(r.id, r.run_id) for r in store.read("rows").collect()} == {(1, 1), (2, 1), (3, 2)}


def test_failing_writes_leave_what_was_there(spark, tmp_path):
    store = Publication(spark, f"file://{tmp_path}/p")
    store.publish("a", {"rows": rows(spark, 1, 2)})
    broken = spark.range(100).select(F.when(F.col("id") == 97, F.raise_error(F.lit("torn"))).otherwise(F.col("id")).cast("bigint").alias("id"))
    # The first table is written, the second one fails in a task: neither is seen, in a new run or in one that is replaced.
    for fingerprint, again in (("b", False), ("a", True)):
        with pytest.raises(Exception, match="torn"):
            store.publish(fingerprint, {"rows": rows(spark, 7), "more": broken}, again=again)
        assert ids(store) == [1, 2]
    assert statuses(store) == {1: ("a", "failed", 2), 2: ("b", "failed", None)}
    assert "torn" in store.runs().where("run_id = 2").first().error
    # Tried again under their own ids.
    assert store.publish("b", {"rows": rows(spark, 8)}) == 2 and ids(store) == [1, 2, 8]
    assert store.publish("a", {"rows": rows(spark, 5)}) == 1 and ids(store) == [5, 8]
    assert {s for _, s, _ in statuses(store).values()} == {"completed"}


def test_writers_that_die(spark, tmp_path):
    path = f"file://{tmp_path}/p"
    store = Publication(spark, path)
    store.publish("a", {"rows": rows(spark, 1)})
    # Killed with its rows written and nothing said: no exception was ever handled.
    run_id, done = store.begin("a", again=True)
    rows(spark, 6, 7).write.parquet(f"{path}/data/rows/run-{run_id}-{'f' * 32}")
    # Killed while a manifest was written.
    (tmp_path / "p" / "manifests" / ".draft-torn").write_text('{"1": {"finger')
    other = Publication(spark, path)
    assert (run_id, done) == (1, False) and ids(other) == [1]
    with pytest.raises(RuntimeError):
        other.vacuum()
    assert other.publish("a", {"rows": rows(spark, 4)}, again=True) == 1
    assert ids(other) == [4] == ids(store)
    assert other.vacuum() == 2 and ids(other) == [4]
    assert sorted(p.name for p in (tmp_path / "p" / "data" / "rows").iterdir())[0].startswith("run-1-")


def test_readers_keep_their_version(spark, tmp_path):
    store = Publication(spark, f"file://{tmp_path}/p")
    store.publish("a", {"rows": rows(spark, 1, 2, 3)})
    before = store.read("rows", "id bigint")
    store.publish("a", {"rows": rows(spark, 4)}, again=True)
    assert sorted(r.id for r in before.collect()) == [1, 2, 3] and ids(store) == [4]


def test_two_writers_lose_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/p"
    threads = [threading.Thread(target=lambda i=i: Publication(spark, path).publish(f"f{i}", {"rows": rows(spark, i)})) for i in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    store = Publication(spark, path)
    assert ids(store) == list(range(6)) and sorted(statuses(store)) == [1, 2, 3, 4, 5, 6]
    assert {f for f, _, _ in statuses(store).values()} == {f"f{i}" for i in range(6)}


SCHEMA = "source_pk bigint, source_type string, source_record_key string, service string, guid string"


def records(seed, n=70):
    rng = random.Random(seed)
    pick = lambda *v: rng.choice(v)
    pks = rng.sample(range(1000), n)
    return [(pk, pick("csv", "json", None), str(rng.randrange(60)) if rng.random() < 0.9 else None, pick("sms", None), str(rng.randrange(40)) if rng.random() < 0.6 else None) for pk in pks]


def batch(spark, rows):
    return {(r.source_pk, r.canonical_id) for r in canonical.resolve_messages(spark.createDataFrame(rows, SCHEMA)).collect()}


def found(store):
    return {(r.source_pk, r.canonical_id) for r in incremental.current(store).collect()}


@pytest.mark.parametrize("seed", [1])
def test_parts_in_any_order_equal_one_batch(spark, tmp_path, seed):
    rows = records(seed)
    rng = random.Random(seed)
    for turn in range(2):
        store = Publication(spark, f"file://{tmp_path}/{turn}")
        order = sorted(rows, key=lambda r: -r[0]) if turn else rng.sample(rows, len(rows))
        size = [18, 36][turn]
        for i in range(0, len(order), size):
            # Parts overlap: a record that is stored already changes nothing.
            incremental.resolve(store, spark.createDataFrame(order[max(0, i - 2) : i + size], SCHEMA), f"part-{i}")
            assert found(store) == batch(spark, order[: i + size])
    assert store.read("records", incremental.RECORDS).count() == len(rows)


def test_imports_happen_once(spark, tmp_path, monkeypatch):
    store = Publication(spark, f"file://{tmp_path}/p")
    rows = records(5, 30)
    first, second = spark.createDataFrame(rows[:15], SCHEMA), spark.createDataFrame(rows[15:], SCHEMA)
    assert incremental.resolve(store, first, "one") == 1
    good = incremental.components
    monkeypatch.setattr(incremental, "components", lambda edges: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError, match="lost"):
        incremental.resolve(store, second, "two")
    monkeypatch.setattr(incremental, "components", good)
    assert found(store) == batch(spark, rows[:15]) and statuses(store)[2][1] == "failed"
    assert incremental.resolve(store, first, "one") == 1  # completed: left as it is
    assert incremental.resolve(store, second, "two") == 2 and found(store) == batch(spark, rows)
    assert {s for _, s, _ in statuses(store).values()} == {"completed"}
    assert incremental.resolve(store, spark.createDataFrame([], SCHEMA), "none") == 3 and found(store) == batch(spark, rows)


def test_streamed_batches_are_imported_once(spark, tmp_path):
    rows = records(8, 40)
    store = Publication(spark, f"file://{tmp_path}/store")

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
        incremental.resolve_stream(stream, store).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()

    spark.createDataFrame(rows[:25], SCHEMA).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
    run()
    assert found(store) == batch(spark, rows[:25])
    # The last batch's commit is lost: it comes again after the restart, under the same number.
    for f in (tmp_path / "check" / "commits").iterdir():
        f.unlink()
    spark.createDataFrame(rows[25:], SCHEMA).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
    run()
    assert found(store) == batch(spark, rows) and store.read("records", incremental.RECORDS).count() == 40


def test_an_import_reads_its_records_once(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    store = Publication(spark, f"file://{tmp_path}/once")
    for part in (0, 1):
        rows = spark.createDataFrame([(i, "csv", str(i // 3), "sms", str(i % 7)) for i in range(part, 60, 2)], SCHEMA)
        incremental.resolve(store, rows.mapInArrow(counted, rows.schema), f"part-{part}")
    assert read.value == 60 and {r.canonical_id for r in incremental.current(store).collect()} == {0}
