"""Bundles of records and errors: what is written is read, and what doesn't agree is refused."""

import json
import math

import pytest
from pyspark.sql import functions as F

from threadloom.sources import staged

SCHEMA = "source_record_key string, guid string, text string, value double, raw binary, at timestamp, parts array<struct<b:int,a:string>>"
READ = "source_record_key string, guid string, text string, value double, at string, parts array<struct<b:int,a:string>>"


def records(spark):
    rows = [("k1", "g1", 'žluť "q"\n ', 1.5, None, None, [(1, "x")]), ("k2", None, None, None, None, None, None), (None, "g3", "no key", 0.0, None, None, None), ("k4", "g4", "nan", math.nan, None, None, None), ("k5", "g5", "bytes", 0.0, b"\x00", None, None), ("", "g6", "empty key", 0.0, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).withColumn("at", F.when(F.col("source_record_key") == "k1", F.lit("2024-01-02 03:04:05").cast("timestamp"))).repartition(3)


def write(spark, path, rows=None):
    staged.write_staged(rows if rows is not None else records(spark), path, "csv", "ab" * 32, ("test", "7"))


def test_round_trip(spark, tmp_path):
    path = f"file://{tmp_path}/b"
    write(spark, path)
    manifest = staged.manifest_of(path)
    assert manifest["counts"] == {"messages": 2, "errors": 4} and manifest["parser"] == {"name": "test", "version": "7"}
    assert manifest["source"] == {"source_type": "csv", "source_sha256": "ab" * 32}
    with pytest.raises(ValueError, match="4 errors"):
        staged.read_staged(spark, path, READ)
    got = {r.source_record_key: r for r in staged.read_staged(spark, path, READ, allow_errors=True).collect()}
    assert got["k1"].text == 'žluť "q"\n ' and got["k1"].value == 1.5 and [tuple(p) for p in got["k1"].parts] == [(1, "x")] and got["k1"].at.startswith("2024-01-02T03:04:05")
    assert got["k2"].text is None and set(got) == {"k1", "k2"}
    errors = {r.guid: r for r in staged.read_errors(spark, path).collect()}
    assert {g: (r.scope, r.error_type, r.source_record_key) for g, r in errors.items()} == {"g3": ("message", "ValueError", None), "g4": ("message", "ValueError", "k4"), "g5": ("message", "TypeError", "k5"), "g6": ("message", "ValueError", "")}
    # Every line has its keys in order, and the fields of the contract.
    for f in (tmp_path / "b" / "messages").glob("*.jsonl"):
        for text in f.read_text().split("\n")[:-1]:
            pairs = json.loads(text, object_pairs_hook=list)
            assert [k for k, _ in pairs] == sorted(k for k, _ in pairs) and {"contract_version", "record_type", "source_sha256", "source_type", "source_record_key"} <= {k for k, _ in pairs}
    with pytest.raises(ValueError, match="already"):
        write(spark, path)


def test_what_disagrees_is_refused(spark, tmp_path):
    good = spark.createDataFrame([(f"k{i}", f"t{i}") for i in range(20)], "source_record_key string, text string").repartition(2)
    schema = "source_record_key string, text string"

    def bundle(name):
        write(spark, f"file://{tmp_path}/{name}", good)
        return tmp_path / name, f"file://{tmp_path}/{name}", staged.manifest_of(f"file://{tmp_path}/{name}")

    folder, path, manifest = bundle("a")
    assert staged.read_staged(spark, path, schema).count() == 20
    # A file of an attempt that nobody counted is not read.
    (folder / "messages" / "other.jsonl").write_text('{"source_record_key":"x"}\n')
    assert staged.read_staged(spark, path, schema).count() == 20
    first = folder / manifest["files"]["messages"][0]["name"]
    first.write_text(first.read_text() + first.read_text().split("\n")[0] + "\n")
    with pytest.raises(ValueError, match="other lines"):
        staged.read_staged(spark, path, schema)
    folder, path, manifest = bundle("b")
    first = folder / manifest["files"]["messages"][0]["name"]
    first.write_text(first.read_text().replace('"source_type":"csv"', '"source_type":"json"', 1))
    with pytest.raises(ValueError, match="another source"):
        staged.read_staged(spark, path, schema)
    for name, change in (("c", {"contract_version": "1"}), ("d", {"counts": {"messages": 19, "errors": 0}})):
        folder, path, manifest = bundle(name)
        (folder / "manifest.json").write_text(json.dumps({**manifest, **change}))
        with pytest.raises(ValueError):
            staged.read_staged(spark, path, schema)
    with pytest.raises(ValueError, match="no manifest"):
        staged.read_staged(spark, f"file://{tmp_path}/none", schema)


def test_a_failing_job_leaves_no_bundle(spark, tmp_path):
    rows = spark.range(0, 1000, 1, 4).select(F.concat(F.lit("k"), F.when(F.col("id") == 990, F.raise_error(F.lit("torn"))).otherwise(F.col("id").cast("string"))).alias("source_record_key"))
    path = f"file://{tmp_path}/b"
    with pytest.raises(Exception, match="torn"):
        write(spark, path, rows)
    assert staged.manifest_of(path) is None
    # Written again in the same place, whatever was left there.
    write(spark, path, spark.createDataFrame([("a",), ("b",)], "source_record_key string"))
    assert sorted(r[0] for r in staged.read_staged(spark, path, "source_record_key string").collect()) == ["a", "b"]
    none = f"file://{tmp_path}/none"
    write(spark, none, spark.createDataFrame([], "source_record_key string"))
    assert staged.read_staged(spark, none, "source_record_key string").count() == 0 == staged.read_errors(spark, none).count()
