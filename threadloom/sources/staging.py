"""Staged records: JSON lines and a manifest, written whole and read only if they agree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .publication import Publication

CONTRACT = "1"


def write_bundle(records: DataFrame, path: str, source_type: str, source_sha: str) -> None:
    """Records first, the manifest last: a bundle without one has not been written to its end."""
    records.write.mode("errorifexists").json(f"{path}/messages")
    spark = records.sparkSession
    n = spark.read.text(f"{path}/messages").count()
    spark.createDataFrame([(CONTRACT, source_type, source_sha, n, 0)], "contract string, source_type string, source_sha string, messages bigint, errors bigint").coalesce(1).write.json(f"{path}/manifest")


def read_bundle(spark: SparkSession, path: str, schema) -> DataFrame:
    """Raises on another contract, on errors, and where the records aren't as many as the manifest says."""
    manifest = spark.read.schema("contract string, source_type string, source_sha string, messages bigint, errors bigint").json(f"{path}/manifest").collect()
    if len(manifest) != 1 or manifest[0].contract != CONTRACT:
        raise ValueError("no manifest of this contract")
    if manifest[0].errors:
        raise ValueError(f"the bundle has {manifest[0].errors} errors")
    if (n := spark.read.text(f"{path}/messages").count()) != manifest[0].messages:
        raise ValueError(f"the manifest says {manifest[0].messages} messages, there are {n}")
    return spark.read.schema(schema).option("mode", "FAILFAST").json(f"{path}/messages")


def write_report(checks: DataFrame, path: str) -> str:
    """Checks (code, n, severity) as one line of JSON with sorted keys; returns its digest. The status is FAIL with any error."""
    from ..operators.gates import report

    one = report(checks)
    one.select("report").coalesce(1).write.mode("overwrite").text(path)
    return one.sparkSession.read.text(path).select(F.sha2("value", 256)).first()[0]


def publish(rows: DataFrame, path: str, run_id: int, signature: str) -> None:
    """Rows as a run of a publication. A run that is published again is replaced when its new rows are complete, and until then
    readers see the old ones; one that fails is marked so and takes nothing away."""
    Publication(rows.sparkSession, path).publish(signature, {"rows": rows}, run_id, again=True)


def read_published(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Rows of the latest run that has published any, with its run_id. Where none has, none if a schema is given, else it raises."""
    store = Publication(spark, path)
    return store.read("rows", schema, store.latest() or 0)
