"""Connected components."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..session import ensure_checkpoints, shared_dir


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the shared folder, for what is read more than once."""
    ensure_checkpoints(df.sparkSession)
    return df.checkpoint()


def kept(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, for what is read more than once, by few of its columns at a time."""
    path = f"{shared_dir(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, keep: Callable[[DataFrame], DataFrame] = checkpointed, most: int = 60) -> DataFrame:
    """Connected components by alternating large-star and small-star steps.

    edges: a, b (long, not null; order, repeats and loops don't matter). Returns node, component (its smallest node) for
    every node of an edge. Each step takes neighbours' minima with map-side combining, then joins them to the edges by the
    complement of the node: both sides of the join have exchanges of their own, so that AQE can split the edges of a hub
    over tasks. `keep` holds the state of a round where lost executors don't matter: a checkpoint, or a table.
    Raises if `most` rounds don't do.
    """

    def settle(df: DataFrame) -> tuple[DataFrame, tuple]:
        """df kept, and its count and digests, observed while it is written."""
        seen = Observation()
        table = keep(df.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("x"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")).alias("y")))
        return table, tuple(seen.get[k] for k in ("n", "x", "y"))

    def lowest(rows: DataFrame, key: str, low: DataFrame) -> DataFrame:
        """rows with m, the minimum of their key."""
        by = F.bitwise_not(F.col(key)).alias("_k")
        return rows.select("*", by).join(low.select(by, "m"), "_k").drop("_k")

    state, was = settle(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    for _ in range(most):
        both = state.select(F.col("u").alias("x"), F.col("v").alias("y")).union(state.select(F.col("v").alias("x"), F.col("u").alias("y")))
        low = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = lowest(both, "x", low).where("y > x").select(F.col("y").alias("u"), F.col("m").alias("v")).where("u <> v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = lowest(large, "u", least).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        state, now = settle(small)
        if now == was:
            roots = state.select(F.col("v").alias("node")).distinct()
            return state.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))
        was = now
    raise RuntimeError("the components did not settle")
