"""Messages resolved as they are imported: new records join what is stored, and only what they touch is written.

A record is of the component of whichever others share a key with it (its source type and record key, or its service and
guid), and a component is named by its smallest source_pk. The publication holds two tables that only grow: `records`, each
with the component it got when it was imported, and `moves`, components that later records made part of another. A record's
canonical id is its component's last move, or the component. An import joins the keys of the new records with those stored,
takes the components of the graph of new records and touched components (union by smallest id), and writes the new
records and the moves of touched components, along with those that had moved there before. So parts in any order, or
all at once, give the same ids; a record that is stored already (by its source_pk) is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.publication import Publication
from .graph import checkpointed, components

RECORDS = "source_pk bigint, source_type string, source_record_key string, service string, guid string, component bigint"
MOVES = "component bigint, target bigint"


def keyed(records: DataFrame, *columns: str) -> DataFrame:
    """A row for each key that a record has, with the columns."""

    def key(kind: str, *parts: str) -> Column:
        return F.to_json(F.struct(F.lit(kind).alias("k"), *parts), {"ignoreNullFields": "false"})

    # As in a batch, a null source type or record key is a value; a null guid is none.
    keys = F.array(key("record", "source_type", "source_record_key"), F.when(F.col("guid").isNotNull(), key("guid", "service", "guid")))
    return records.select(*columns, F.explode(F.array_compact(keys)).alias("key"))


def moves(store: Publication) -> DataFrame:
    """component and target: the last move of each component that has moved."""
    return store.read("moves", MOVES).groupBy("component").agg(F.max_by("target", "run_id").alias("target"))


def current(store: Publication) -> DataFrame:
    """source_pk and canonical_id of all records that are published."""
    rows = store.read("records", RECORDS).join(moves(store), "component", "left")
    return rows.select("source_pk", F.coalesce("target", "component").alias("canonical_id"))


def resolve(store: Publication, records: DataFrame, fingerprint: str) -> int:
    """Imports records (source_pk, source_type, source_record_key, service, guid) as the run of the fingerprint, exactly once:
    a completed one is left as it is, a failed one is done anew under its id. Returns the run's id."""
    run_id, done = store.begin(fingerprint)
    if done:
        return run_id
    with store.attempt(run_id) as write:
        stored, moved = store.read("records", RECORDS), moves(store)
        columns = ("source_pk", "source_type", "source_record_key", "service", "guid")
        new = checkpointed(records.select(*columns).dropDuplicates(["source_pk"]).join(stored.select("source_pk"), "source_pk", "left_anti"))
        fresh = keyed(new, F.col("source_pk").alias("node"))
        # Stored components that hold a key of the new records, by their present names.
        touched = keyed(stored, "component").join(fresh.select("key").distinct(), "key", "left_semi").distinct()
        touched = touched.join(moved, "component", "left").select("key", F.coalesce("target", "component").alias("node")).distinct()
        # A stored component and a new record never have one name: what names a component is stored.
        told = checkpointed(fresh.select("key", "node", F.lit(False).alias("stored")).distinct().union(touched.select("key", "node", F.lit(True))))
        members = told.select("key", "node")
        low = members.groupBy("key").agg(F.min("node").alias("low"), F.count("*").alias("n")).where("n > 1").select("key", "low")
        edges = members.join(low, "key").where("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b"))
        found = components(edges)
        write("records", new.join(found.select(F.col("node").alias("source_pk"), "component"), "source_pk", "left").select(*columns, F.coalesce("component", "source_pk").alias("component")))
        # A component that becomes part of another takes along what had moved to it.
        became = told.where("stored").select("node").distinct().join(found, "node").where("node <> component").select("node", F.col("component").alias("to"))
        along = moved.join(became, F.col("target") == F.col("node")).select("component", F.col("to").alias("target"))
        write("moves", became.select(F.col("node").alias("component"), F.col("to").alias("target")).union(along))
    return run_id


def resolve_stream(stream: DataFrame, store: Publication, name: str = "stream"):
    """A writer that imports each batch once, whatever is repeated after a restart: a batch is known by its number."""
    return stream.writeStream.outputMode("append").foreachBatch(lambda batch, epoch: resolve(store, batch, f"{name}-{epoch}"))
