"""CSV, JSON and JSON lines with columns under many names, and what kind of file it is."""

from __future__ import annotations

import re
import sqlite3

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from ..operators import canonical as ca

# Names of columns, without anything but letters and digits, by what they mean.
ALIASES = {
    "id": ("id", "messageid", "msgid", "recordid"),
    "guid": ("guid", "messageguid", "uuid"),
    "conversation": ("conversation", "conversationid", "chat", "chatid", "thread", "threadid", "session"),
    "sender": ("sender", "senderid", "from", "fromid", "author", "participant", "contact"),
    "timestamp": ("timestamp", "datetime", "date", "sentdate", "createdat", "time"),
    "text": ("text", "message", "messagetext", "body", "content"),
    "service": ("service", "servicetype", "channel", "platform"),
    "direction": ("direction", "sentreceived", "incomingoutgoing", "fromme", "isfromme", "sentbyme"),
    "attachment": ("attachment", "attachments", "attachmentpath", "attachmentfile", "filename", "file"),
}
# The same for exports of one chat session a file.
SESSION_ALIASES = {
    "conversation": ("chatsession", "chatsessionname", "conversation", "conversationname", "chat", "chatname", "session"),
    "sender": ("sender", "sendername", "from", "fromname", "participant", "contact"),
    "timestamp": ("sentdate", "date", "datetime", "sentdatetime", "timestamp", "time"),
    "text": ("message", "messagetext", "text", "body", "content"),
    "service": ("service", "servicetype", "type"),
    "direction": ("direction", "sentreceived", "incomingoutgoing", "fromme", "sentbyme"),
    "attachment": ("attachment", "attachments", "attachmentfilename", "attachmentfile", "filename", "file"),
    "attachment_type": ("attachmenttype", "mimetype", "mediatype"),
}
# Plain names of columns that tell a session export, and a message table, by their header.
SESSION_MARKERS = ("chatsession", "chatsessionname")
MESSAGE_MARKERS = ("message", "messagetext", "text", "body", "content", "sentdate", "date", "datetime", "timestamp", "sender", "sendername", "from", "participant")
# Columns of a table of messages under other names, the first name found is taken.
TABLE_ALIASES = {
    "membership_id": ("membership_id",),
    "message_id": ("message_id", "id", "guid", "message_guid"),
    "conversation_id": ("conversation_id", "chat_id", "thread_id", "conversation"),
    "contact": ("contact", "contact_name", "conversation_title", "chat_name", "display_name"),
    "sender": ("sender", "sender_name", "participant_name", "author", "from_name"),
    "timestamp": ("timestamp", "sent_at_utc_us", "sent_at_utc", "created_at_utc", "date_utc", "sent_at", "created_at", "date"),
    "timestamp_precision": ("timestamp_precision",),
    "timestamp_quality": ("timestamp_quality",),
    "text": ("text", "body", "message_text", "raw_text", "content"),
}
SQLITE_MAGIC = b"SQLite format 3\x00"


def resolve_columns(columns: list[str], aliases: dict[str, tuple[str, ...]] = ALIASES) -> dict[str, str]:
    """The first column, in their order, whose name is among the aliases of each meaning."""
    plain = {c: re.sub(r"[^a-z0-9]", "", c.lower()) for c in columns}
    found = {}
    for meaning, names in aliases.items():
        for c in columns:
            if plain[c] in names:
                found[meaning] = c
                break
    return found


def to_records(rows: DataFrame, first_ordinal: int = 1) -> DataFrame:
    """Rows of any columns as records; raises unless a text, time or sender is among them. All values stay in raw_payload."""
    have = resolve_columns(rows.columns)
    if not have.keys() & {"text", "timestamp", "sender"}:
        raise ValueError("no column of text, time or sender")
    c = lambda m: F.nullif(F.trim(F.col(f"`{have[m]}`").cast("string")), F.lit("")) if m in have else F.lit(None).cast("string")
    t = ca.parse_timestamp(c("timestamp"))
    ordinal = F.col("_ordinal") if "_ordinal" in rows.columns else F.monotonically_increasing_id()
    return rows.select(
        (ordinal + first_ordinal).alias("source_ordinal"), c("id").alias("source_message_id"), c("guid").alias("guid"), c("conversation").alias("source_conversation_id"), c("sender").alias("sender"), t["us"].alias("timestamp_us"), t["precision"].alias("timestamp_precision"),
        c("text").alias("text"), ca.parse_direction(c("direction")).alias("is_outgoing"), c("service").alias("service"), c("attachment").alias("attachment_path"), F.to_json(F.struct(*[F.col(f"`{x}`") for x in rows.columns if x not in ("_ordinal", "_file")])).alias("raw_payload"),
    )


def sniff_delimiter(sample: str) -> str:
    """Of comma, semicolon and tab the one that the first line has most of."""
    line = sample.lstrip("﻿").split("\n", 1)[0]
    return max((",", ";", "\t"), key=lambda d: (line.count(d), d == ","))


def _read_csv(spark: SparkSession, path: str, delimiter: str | None, encoding: str) -> DataFrame:
    """Rows of CSV files with their file and their place in it, from 0: a file is read by one task, in order."""
    if delimiter is None:
        head = spark.read.option("encoding", encoding).text(path).limit(1).collect()
        delimiter = sniff_delimiter(head[0].value if head else "")
    rows = spark.read.csv(path, header=True, sep=delimiter, multiLine=True, escape='"', encoding=encoding)
    named = rows.select(*[F.col(f"`{c}`").alias(c.lstrip("\ufeff")) for c in rows.columns], F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_at"))
    return named.withColumn("_ordinal", F.row_number().over(Window.partitionBy("_file").orderBy("_at")) - 1).drop("_at")


def read_csv(spark: SparkSession, path: str, delimiter: str | None = None, encoding: str = "UTF-8") -> DataFrame:
    """The delimiter is taken from the first line of the first file; quoted line breaks are kept; the first row of a file is 2."""
    return to_records(_read_csv(spark, path, delimiter, encoding), 2)


def read_sessions_csv(spark: SparkSession, path: str, delimiter: str | None = None) -> DataFrame:
    """Exports of chat sessions: ids are row:<n> of the file (from 2), a blank is a null, a row without a session belongs to
    that of its file's name, a time without an offset stays raw, and an attachment is one of the row's."""
    rows = _read_csv(spark, path, delimiter, "UTF-8")
    have = resolve_columns([c for c in rows.columns if not c.startswith("_")], SESSION_ALIASES)
    if not have.keys() & {"text", "timestamp", "sender"}:
        raise ValueError("no column of text, time or sender")
    c = lambda m: F.nullif(F.col(f"`{have[m]}`"), F.lit("")) if m in have else F.lit(None).cast("string")
    row = F.concat(F.lit("row:"), (F.col("_ordinal") + 2).cast("string"))
    stem = F.regexp_replace(F.url_decode(F.regexp_extract("_file", r"([^/]+)$", 1)), r"\.[^.]*$", "")
    t = ca.parse_timestamp(c("timestamp"))
    name = F.regexp_extract(c("attachment"), r"([^/]*)/*$", 1)
    attachment = F.when(c("attachment").isNotNull(), F.struct(F.concat(row, F.lit(":attachment:1")).alias("source_attachment_id"), name.alias("filename"), c("attachment_type").alias("mime_type"), c("attachment").alias("source_path")))
    return rows.select(
        (F.col("_ordinal") + 2).alias("source_ordinal"), row.alias("source_message_id"), F.coalesce(c("conversation"), stem).alias("source_conversation_id"), c("sender").alias("sender"), c("timestamp").alias("timestamp_raw"), t["us"].alias("timestamp_us"),
        F.when(t["precision"] == "numeric_unknown", "text").otherwise(t["precision"]).alias("timestamp_precision"), c("text").alias("text"), F.lit(have.get("text")).alias("text_source"), ca.parse_direction(F.regexp_replace(F.lower(c("direction")), "[^a-z0-9]", "")).alias("is_outgoing"),
        c("service").alias("service"), F.array_compact(F.array(attachment)).alias("attachments"), F.to_json(F.struct(*[F.col(f"`{x}`") for x in rows.columns if not x.startswith("_")])).alias("raw_payload"),
    )


def read_json(spark: SparkSession, path: str, lines: bool) -> DataFrame:
    """A list of objects, an object with `messages`, one object, or an object a line; malformed input raises."""
    rows = spark.read.option("mode", "FAILFAST").json(path, multiLine=not lines)
    if not lines and "messages" in rows.columns:
        rows = rows.select(F.explode("messages").alias("m")).select("m.*")
    return to_records(rows)


@F.pandas_udf(BooleanType())
def _is_chat_database(content: pd.Series) -> pd.Series:
    """Whether bytes are an SQLite database whose table `message` has a date and a direction; never raises."""

    def one(blob: bytes) -> bool:
        db = sqlite3.connect(":memory:")
        try:
            # A database of a write-ahead log opens in memory only as one of a rollback journal.
            db.deserialize(blob[:18] + b"\x01\x01" + blob[20:])
            return {"date", "is_from_me"} <= {row[1] for row in db.execute("PRAGMA table_info(message)")}
        except sqlite3.Error:
            return False
        finally:
            db.close()

    return content.map(lambda blob: blob is not None and one(blob))


def detect(files: DataFrame) -> DataFrame:
    """files: path, content (binaryFile). path, kind (sqlite, csv, jsonl, json, txt or unknown), source_type, confidence (exact,
    high, extension or none) and requires_explicit_mode. Databases are told by their tables, CSV files by their header, others by their suffix."""
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    line = F.split(F.regexp_replace(F.decode(F.substring("content", 1, 8192), "UTF-8"), "^\ufeff", ""), "\r\n|\n|\r")[0]
    count = lambda d: F.length(line) - F.length(F.replace(line, F.lit(d), F.lit("")))
    cells = F.when((count(";") > count(",")) & (count(";") >= count("\t")), F.split(line, ";")).when(count("\t") > count(","), F.split(line, "\t")).otherwise(F.split(line, ","))
    names = F.transform(cells, lambda x: F.regexp_replace(F.lower(x), "[^a-z0-9]", ""))
    has = lambda markers: F.arrays_overlap(names, F.array(*[F.lit(m) for m in markers]))
    sqlite = F.substring("content", 1, len(SQLITE_MAGIC)) == F.lit(SQLITE_MAGIC)
    kind = F.when(sqlite, "sqlite").when(suffix.isin(".csv", ".jsonl", ".json", ".txt"), F.substring(suffix, 2, 5)).otherwise("unknown")
    source_type = (
        F.when(sqlite, F.when(F.col("_chat"), "imessage_chat_db").otherwise("unknown"))
        .when(suffix == ".csv", F.when(~has(MESSAGE_MARKERS), "unknown").when(has(SESSION_MARKERS), "imazing_messages_csv").otherwise("generic_message_csv"))
        .when(suffix == ".jsonl", "generic_message_jsonl").when(suffix == ".json", "generic_message_json").when(suffix == ".txt", "generic_message_text").otherwise("unknown")
    )
    confidence = F.when(F.col("source_type") == "unknown", "none").when(F.col("source_type") == "imessage_chat_db", "exact").when(F.col("source_type").endswith("_csv"), "high").otherwise("extension")
    # Only the bytes of databases go to Python.
    told = files.withColumn("_chat", _is_chat_database(F.when(sqlite, F.col("content")))).select("path", kind.alias("kind"), source_type.alias("source_type"))
    return told.withColumns({"confidence": confidence, "requires_explicit_mode": F.col("source_type") == "generic_message_text"})


def message_columns(columns: list[str]) -> tuple[int, dict[str, str]]:
    """How well columns (whatever their case) make a table of messages, and which is which; -1 without an id, a time or a text."""
    plain = {c.lower(): c for c in columns}
    found = {meaning: plain[hits[0]] for meaning, names in TABLE_ALIASES.items() if (hits := [n for n in names if n in plain])}
    if not {"message_id", "timestamp", "text"} <= found.keys():
        return -1, found
    extra = 2 * ("sender" in found) + 2 * bool({"contact", "conversation_id"} & found.keys()) + 4 * ("membership_id" in found)
    return len(found) + extra, found


def discover(tables: dict[str, list[str]]) -> tuple[str, dict[str, str]]:
    """The table (name: columns) that makes messages best, the first by name among equals; raises if none does."""
    rated = {name: message_columns(columns) for name, columns in sorted(tables.items())}
    best = max(rated, key=lambda name: rated[name][0], default=None)
    if best is None or rated[best][0] < 0:
        raise ValueError("no table has columns of an id, a time and a text")
    return best, rated[best][1]


def discover_catalog(spark: SparkSession, database: str) -> tuple[str, dict[str, str]]:
    """The same over the tables and views of a database of the catalog; nothing but their schemas is read."""
    return discover({t.name: [c.name for c in spark.catalog.listColumns(f"{database}.{t.name}")] for t in spark.catalog.listTables(database)})
