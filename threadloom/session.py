"""A session with the settings that results depend on."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def configured(builder: SparkSession.Builder | None = None) -> SparkSession:
    """Times are UTC, plans adapt at run time; everything else is the cluster's."""
    builder = builder or SparkSession.builder
    return builder.config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir. On one machine (master local) it may be unset, and is then
    one of our own; on a cluster nothing would be kept there, and so that raises."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='threadloom-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def ensure_checkpoints(spark: SparkSession) -> None:
    """Checkpoints go to the shared folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
