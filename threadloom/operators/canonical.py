"""From raw records to canonical rows: keys, times, identities, deduplication, memberships, attachments, replies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import let
from .graph import checkpointed

#: Between the parts of a key.
SEPARATOR = "\u001f"
APPLE_EPOCH = 978_307_200
# They must be these for results to agree.
OUTGOING = ("outgoing", "sent", "me", "mine", "true", "yes", "1")
INCOMING = ("incoming", "received", "false", "no", "0")
PRECISIONS = ("microsecond", "millisecond", "second", "minute", "day")


def stable_key(*parts: Column) -> Column:
    """SHA-256 of the parts; null and empty are one."""
    return F.sha2(F.concat_ws(SEPARATOR, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def source_record_key(source_type: Column, snapshot_sha: Column, guid: Column, record_id: Column, conversation: Column) -> Column:
    """Of the chat database by its snapshot and row, of everything else by its own ids."""
    return F.when(source_type == "imessage_chat_db", stable_key(snapshot_sha, F.lit("message"), record_id)).otherwise(stable_key(snapshot_sha, guid, record_id, conversation))


def apple_time_us(raw: Column) -> Column:
    """Seconds or, from 1e11 on, nanoseconds since 2001, as UTC microseconds."""
    return F.when(F.abs(raw) >= 100_000_000_000, F.floor(raw / 1000).cast("bigint") + APPLE_EPOCH * 1_000_000).otherwise((raw.cast("bigint") + APPLE_EPOCH) * 1_000_000)


def apple_time_precision(raw: Column) -> Column:
    return F.when(raw.isNull(), None).when(F.abs(raw) >= 100_000_000_000, "nanosecond").otherwise("second")


def parse_timestamp(raw: Column) -> Column:
    """A struct of us (null unless the text has an offset) and precision: microsecond, second, local_text, numeric_unknown or text."""
    t = F.trim(raw)
    iso = t.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?")
    zoned = iso & t.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    parsed = F.try_to_timestamp(F.regexp_replace(F.regexp_replace(t, r"Z$", "+00:00"), r"([+-]\d{2})(\d{2})$", "$1:$2"))
    us = F.when(zoned, F.unix_micros(parsed))
    precision = (
        F.when(t.isNull() | (t == ""), None).when(us.isNotNull(), F.when(t.rlike(r"\.\d+"), "microsecond").otherwise("second")).when(iso & ~zoned, "local_text")
        .when(t.rlike(r"^[+-]?\d+(\.\d+)?$"), "numeric_unknown").otherwise("text")
    )
    return F.struct(us.alias("us"), precision.alias("precision"))


def canonical_precision(p: Column) -> Column:
    return F.when(p == "nanosecond", "microsecond").when(p.isin(*PRECISIONS), p).otherwise("unknown")


def parse_direction(raw: Column) -> Column:
    t = F.lower(F.trim(raw.cast("string")))
    return F.when(t.isin(*OUTGOING), True).when(t.isin(*INCOMING), False)


def identity_type(raw: Column) -> Column:
    bare = F.regexp_replace(raw, r"[ +().-]", "")
    return F.when(raw.contains("@"), "email").when((bare != "") & bare.rlike(r"^\d+$"), "phone").otherwise("imessage_handle")


def normalized_identity(raw: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(F.trim(raw), r"[\s().-]+", ""), r"^00", "+")
    return F.when(raw.contains("@"), F.lower(F.trim(raw))).otherwise(bare)


def participants(records: DataFrame) -> DataFrame:
    """Distinct identities (columns identity, is_self) with ids by order of type and value; is_self sticks."""
    i = F.col("identity")
    per = records.where("identity IS NOT NULL").groupBy(identity_type(i).alias("identity_type"), normalized_identity(i).alias("normalized_value")).agg(F.bool_or(F.coalesce("is_self", F.lit(False))).alias("is_self"), F.count("*").alias("records"))
    # Numbered within hashed shares, and shares by offsets, so that no task sees all identities.
    return dense_ids(per, ["identity_type", "normalized_value"], "participant_id")


def dense_ids(rows: DataFrame, order: list[str], name: str, parts: int = 64) -> DataFrame:
    """Ids from 1 without gaps, in the order of the columns: row numbers within ranges, plus how many the ranges before have.
    The numbered rows are kept: ranges found a second time may be other ones."""
    ranged = rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id())
    numbered = checkpointed(ranged.withColumn("_n", F.row_number().over(Window.partitionBy("_part").orderBy(*order))))
    sizes = numbered.groupBy("_part").agg(F.count("*").alias("_size"))
    offsets = sizes.select("_part", (F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).alias("_offset"))  # `parts` rows
    return numbered.join(F.broadcast(offsets), "_part").select((F.col("_n") + F.col("_offset")).cast("bigint").alias(name), *rows.columns)


def snapshot_key(sha: Column, fingerprint: Column) -> Column:
    return F.coalesce(sha, F.concat(F.lit("fingerprint:"), fingerprint))


def conversation_key(canonical: Column, source_type: Column, snapshot: Column, conversation: Column) -> Column:
    """Conversations of several snapshots are one only by an explicit canonical key."""
    return F.coalesce(canonical, stable_key(source_type, snapshot, conversation))


def conversation_refs(records: DataFrame) -> DataFrame:
    """record_id and refs (array of structs conversation_key, conversation_id, guid, rowid, canonical_key) to one row for each
    distinct reference, the first of equal ones, in order; the first is primary."""
    rows = records.select("record_id", "source_type", F.posexplode("refs").alias("position", "r"))
    key = F.coalesce("r.conversation_key", "r.conversation_id", F.concat(F.lit("guid:"), "r.guid"), F.concat(F.lit("rowid:"), F.col("r.rowid").cast("string")))
    canonical = F.coalesce("r.canonical_key", F.concat("source_type", F.lit(":chat-guid:"), "r.guid"))
    named = rows.select("record_id", "position", key.alias("conversation_key"), canonical.alias("canonical_key")).where("conversation_key IS NOT NULL")
    once = named.withColumn("_n", F.row_number().over(Window.partitionBy("record_id", "conversation_key", "canonical_key").orderBy("position"))).where("_n = 1").drop("_n")
    return once.withColumn("is_primary", F.row_number().over(Window.partitionBy("record_id").orderBy("position")) == 1)


def resolve_messages(records: DataFrame) -> DataFrame:
    """Adds canonical_id, the smallest source_pk of the records that are one message: equal source type and record key, or
    equal service (null-safe) and guid. Never by text. Chains of both rules are followed, so that the result doesn't hang on
    the order of imports."""
    from .graph import components

    def shared(rows: DataFrame, *key: str) -> DataFrame:
        """source_pk with the smallest one of its key, where there are others; only rows that have the key take part."""
        low = rows.groupBy(*key).agg(F.min("source_pk").alias("b"), F.count("*").alias("n")).where("n > 1").select(*[F.col(k).alias(f"_{k}") for k in key], "b")
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key]
        return rows.join(low, reduce(lambda x, y: x & y, same)).select(F.col("source_pk").alias("a"), "b").where("a <> b")

    named = records.select("source_pk", "source_type", "source_record_key", "service", "guid")
    edges = shared(named, "source_type", "source_record_key").union(shared(named.where("guid IS NOT NULL").drop("source_type", "source_record_key"), "service", "guid"))
    of = components(edges)
    return records.join(of.select(F.col("node").alias("source_pk"), "component"), "source_pk", "left").withColumn("canonical_id", F.coalesce("component", "source_pk")).drop("component")


def attachment_occurrences(rows: DataFrame) -> DataFrame:
    """record_key, position, attachment_id, sha256 to occurrences (all kept) with the key of their blob (by content, else their own)."""
    key = F.concat_ws(":", "record_key", F.lit("attachment"), F.coalesce(F.col("attachment_id").cast("string"), F.col("position").cast("string")), F.lit("position"), F.col("position").cast("string"))
    return rows.withColumn("occurrence_key", key).withColumn("blob_key", F.coalesce("sha256", F.concat(F.lit("occurrence:"), key)))


def attachment_conflicts(occurrences: DataFrame) -> DataFrame:
    return occurrences.groupBy("occurrence_key").agg(F.count_distinct("sha256").alias("n")).where("n > 1")


def reply_relations(messages: DataFrame) -> DataFrame:
    """message_id, service, guid, reply_to_guid to resolved replies; those without a target are left out."""
    target = messages.where("guid IS NOT NULL").select(F.col("service").alias("_s"), F.col("guid").alias("_g"), F.col("message_id").alias("target_message_id"))
    replies = messages.where("reply_to_guid IS NOT NULL")
    joined = replies.join(target, F.col("service").eqNullSafe(F.col("_s")) & (F.col("reply_to_guid") == F.col("_g")))
    return joined.select(F.col("message_id").alias("source_message_id"), "target_message_id", F.lit("reply_to").alias("relation_type"))


def local_time(rows: DataFrame) -> DataFrame:
    """local_iso and stated_offset_min to the offset that holds, ok, and the conflict where both are given and differ."""
    tail = F.regexp_extract("local_iso", r"([+-])(\d{2}):?(\d{2})$", 0)

    def signed(t: Column) -> Column:
        minutes = F.substring(t, 2, 2).try_cast("int") * 60 + F.right(t, F.lit(2)).try_cast("int")
        return F.when(F.col("local_iso").endswith("Z"), 0).when(t.startswith("-"), -minutes).when(t.startswith("+"), minutes)

    # Exploded, so that the offset is a column that is read, not an expression that is copied to each place that names it.
    rows = rows.select("*", F.explode(F.array(let(tail, signed))).alias("_own"))
    own = F.col("_own")
    return rows.select(
        *[c for c in rows.columns if c != "_own"], own.alias("iso_offset_min"), F.coalesce("stated_offset_min", own).alias("offset_min"),
        (F.col("local_iso").isNull() | (own.isNotNull() & own.between(-840, 840))).alias("iso_ok"), (F.col("stated_offset_min").isNotNull() & own.isNotNull() & (F.col("stated_offset_min") != own)).alias("conflict"),
    )


def pending_imports(candidates: DataFrame, runs: DataFrame) -> DataFrame:
    """Sources (fingerprint) whose import hasn't been completed."""
    return candidates.join(runs.where("status = 'completed'").select("fingerprint"), "fingerprint", "left_anti")


def source_hash(record_key: Column, *fields: Column) -> Column:
    """The record key, or where there is none a digest of all fields; null and empty are told apart."""
    return F.coalesce(record_key, F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256))


def memberships(refs: DataFrame, canonical: DataFrame) -> DataFrame:
    """One membership for each message and conversation, with the first position it is referred to at; of each message the
    first is primary. refs: as conversation_refs returns them; canonical: record_id, canonical_id."""
    key = F.coalesce("canonical_key", "conversation_key").alias("conversation")
    rows = refs.join(canonical, "record_id").groupBy("canonical_id", key).agg(F.min(F.struct("record_id", "position")).alias("first"))
    order = Window.partitionBy("canonical_id").orderBy("first", "conversation")
    return rows.select("canonical_id", "conversation", F.col("first.position").alias("position"), (F.row_number().over(order) == 1).alias("is_primary"))


def availability(path: Column, found: Column, sha: Column) -> Column:
    """external if the file is there or its content is known, missing if only its path is, else unknown."""
    return F.when(F.coalesce(found, F.lit(False)) | (path.isNull() & sha.isNotNull()), "external").when(path.isNotNull(), "missing").otherwise("unknown")


def apple_metadata(rows: DataFrame) -> DataFrame:
    """What a phone notes of a message: whom it is about (only with a target), when it was edited or taken back (dates that
    aren't 0, raw and UTC), its flags that are set, and the bytes of its history of edits."""
    about = F.when(F.coalesce(F.trim("associated_message_guid"), F.lit("")) != "", F.struct(F.col("associated_message_guid").alias("target_guid"), F.col("associated_message_type").alias("type")))
    dated = lambda c: F.when(F.coalesce(F.col(c), F.lit(0)) != 0, F.struct(F.col(c).alias("raw"), apple_time_us(F.col(c)).alias("us")))
    flags = F.array_compact(F.array(*[F.when(F.col(c) > 0, F.lit(c)) for c in ("is_read", "is_delivered", "is_sent", "is_audio_message", "is_system_message") if c in rows.columns]))
    return rows.select("*", about.alias("associated"), dated("date_edited").alias("edited"), dated("date_retracted").alias("retracted"), flags.alias("flags"), F.length(F.unbase64("edit_history")).alias("edit_history_bytes"))


def json_safe(c: Column, binary: bool) -> Column:
    """Bytes as {"encoding": "base64", "data": ...}, anything else as its text; null stays null."""
    return F.when(c.isNotNull(), F.to_json(F.struct(F.lit("base64").alias("encoding"), F.base64(c).alias("data")))) if binary else c.cast("string")


def merge_local_times(messages: DataFrame, observations: DataFrame) -> DataFrame:
    """messages: message_id, timezone_offset_min and local_iso (null where unknown). observations: message_id, local_iso,
    stated_offset_min, as sources give them, any number a message and in any order.

    An observation fails whose local time has no offset of whole minutes within 840, or another one than is stated; it gives
    nothing and is counted in `failed`. Of the others an unknown field takes the smallest value (offsets as numbers, times as
    text), and every other value goes to `conflicts` (a map of the field to the sorted values, null if there are none), as do all that differ
    from a field that was known. So the result hangs on the set of observations alone. Those of other messages are left out.
    """
    told = local_time(observations.where("message_id IS NOT NULL")).withColumn("_ok", F.col("iso_ok") & ~F.col("conflict") & (F.col("offset_min").isNull() | F.col("offset_min").between(-840, 840)))
    # One row a message: what its fields hold of different values, each once, and its failures.
    fair = lambda name: F.array_sort(F.collect_set(F.when(F.col("_ok"), F.col(name))))
    held = told.groupBy("message_id").agg(
        F.transform(fair("offset_min"), lambda v: v.cast("string")).alias("_timezone_offset_min"), fair("local_iso").alias("_local_iso"), F.count_if(~F.col("_ok")).alias("_failed"),
    )
    joined = messages.join(held, "message_id", "left")
    known = {f: F.coalesce(F.col(f).cast("string"), F.get(F.col(f"_{f}"), F.lit(0))) for f in ("timezone_offset_min", "local_iso")}
    unlike = lambda f: F.filter(F.col(f"_{f}"), lambda v: v != known[f])
    others = F.array(*[F.struct(F.lit(f).alias("key"), unlike(f).alias("value")) for f in known])
    clash = F.map_from_entries(F.filter(others, lambda e: F.coalesce(F.size(e.value) > 0, F.lit(False))))
    return joined.select(
        *[c for c in messages.columns if c not in (*known, "conflicts", "failed")], known["timezone_offset_min"].cast("int").alias("timezone_offset_min"), known["local_iso"].alias("local_iso"),
        F.when(F.size(clash) > 0, clash).alias("conflicts"), F.coalesce("_failed", F.lit(0)).alias("failed"),
    )
