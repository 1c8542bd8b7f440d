"""A phone's chat database (SQLite) as records. Its tables are read by ranges of row ids, from a file that every task can open,
and the relations are joined by Spark."""

from __future__ import annotations

import hashlib
import os
import sqlite3
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators import canonical as ca

TABLES = {
    "message": "ROWID bigint, guid string, text string, attributedBody binary, handle_id bigint, date bigint, is_from_me bigint, service string, thread_originator_guid string",
    "handle": "ROWID bigint, id string",
    "chat": "ROWID bigint, guid string",
    "chat_message_join": "ROWID bigint, chat_id bigint, message_id bigint",
    "chat_handle_join": "chat_id bigint, handle_id bigint",
    "attachment": "ROWID bigint, filename string, mime_type string, transfer_name string, total_bytes bigint",
    "message_attachment_join": "ROWID bigint, message_id bigint, attachment_id bigint",
}


class SqliteSource(DataSource):
    """Format "sqlite_table": options path and table; a table or column that the file lacks is empty."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self) -> str:
        return TABLES[self.options["table"]]

    def reader(self, schema) -> DataSourceReader:
        return SqliteReader(self.options["path"], self.options["table"], [f.name for f in schema.fields], int(self.options.get("rows", 100_000)))


class RowRange(InputPartition):
    def __init__(self, first: int, last: int):
        super().__init__((first, last))
        self.first, self.last = first, last


class SqliteReader(DataSourceReader):
    """Tasks read ranges of row ids, of about `rows` ids each, by the table's own tree: no task reads what another does."""

    def __init__(self, path: str, table: str, columns: list[str], rows: int):
        self.path, self.table, self.columns, self.rows = path, table, columns, rows

    def partitions(self) -> list[RowRange]:
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            if not db.execute(f'PRAGMA table_info("{self.table}")').fetchall():
                return []
            first, last = db.execute(f'SELECT min(ROWID), max(ROWID) FROM "{self.table}"').fetchone()
            if first is None:
                return []
            # Ids may lie far apart: a thousand ranges at most, and only those that hold any.
            step = max(self.rows, -(-(last - first + 1) // 1000))
            ranges = [RowRange(at, min(at + step - 1, last)) for at in range(first, last + 1, step)]
            held = f'SELECT EXISTS (SELECT 1 FROM "{self.table}" WHERE ROWID BETWEEN ? AND ?)'
            return [r for r in ranges if db.execute(held, (r.first, r.last)).fetchone()[0]]

    def read(self, partition: RowRange | None) -> Iterator[tuple]:
        if partition is None:  # of a table without rows
            return
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            have = {r[1] for r in db.execute(f'PRAGMA table_info("{self.table}")')}
            picked = ", ".join("ROWID" if c == "ROWID" else f'"{c}"' if c in have else "NULL" for c in self.columns)
            yield from db.execute(f'SELECT {picked} FROM "{self.table}" WHERE ROWID BETWEEN ? AND ?', (partition.first, partition.last))


def snapshot(path: str, folder: str) -> tuple[str, str]:
    """One copy of the database by SQLite's own backup, so that writes in its log are seen and none in between; the copy's
    path and SHA-256. All tables are read from it, and so agree. folder: one that every task can read."""
    copy = os.path.join(folder, f"snapshot-{uuid.uuid4().hex[:12]}.db")
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as source, sqlite3.connect(copy) as target:
        source.backup(target)
    with open(copy, "rb") as f:
        return copy, hashlib.file_digest(f, "sha256").hexdigest()


def tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a snapshot, or of a database that nobody writes to."""
    spark.dataSource.register(SqliteSource)
    return {t: spark.read.format("sqlite_table").option("path", path).option("table", t).load() for t in TABLES}


def chat_relations(t: dict[str, DataFrame]) -> DataFrame:
    """message_id and its chats in order of their id, each once, with key, guid and participants."""
    people = t["chat_handle_join"].join(t["handle"], F.col("handle_id") == F.col("ROWID")).groupBy("chat_id").agg(F.transform(F.array_sort(F.collect_set(F.struct("handle_id", "id"))), lambda x: x.id).alias("participants"))
    chat = t["chat"].select(F.col("ROWID").alias("chat_id"), "guid").join(people, "chat_id", "left")
    key = F.coalesce(F.concat(F.lit("guid:"), "guid"), F.concat(F.lit("rowid:"), F.col("chat_id").cast("string")))
    links = t["chat_message_join"].select("chat_id", "message_id").distinct().join(chat, "chat_id")
    return links.groupBy("message_id").agg(F.array_sort(F.collect_list(F.struct("chat_id", key.alias("conversation_key"), "guid", "participants"))).alias("conversations"))


def attachment_relations(t: dict[str, DataFrame]) -> DataFrame:
    """message_id and its attachments in order of their id, as often as they are linked."""
    a = t["attachment"].withColumnRenamed("ROWID", "attachment_id")
    return t["message_attachment_join"].drop("ROWID").join(a, "attachment_id").groupBy("message_id").agg(F.array_sort(F.collect_list(F.struct("attachment_id", "filename", "mime_type", "transfer_name", "total_bytes"))).alias("attachments"))


def records(t: dict[str, DataFrame]) -> DataFrame:
    """A record for each row of message; those of no chat get a conversation of their own. Text falls back to the decoded body."""
    from ..functions.body import decode_body

    handle = t["handle"].select(F.col("ROWID").alias("handle_id"), F.col("id").alias("sender"))
    m = t["message"].withColumnRenamed("ROWID", "message_id").join(handle, "handle_id", "left")
    joined = m.join(chat_relations(t), "message_id", "left").join(attachment_relations(t), "message_id", "left")
    orphan = F.array(F.struct(F.lit(None).cast("bigint").alias("chat_id"), F.concat(F.lit("orphan:"), F.col("message_id").cast("string")).alias("conversation_key"), F.lit(None).cast("string").alias("guid"), F.array().cast("array<string>").alias("participants")))
    return joined.select(
        "message_id", "guid", F.coalesce("text", decode_body(F.when(F.col("text").isNull(), F.col("attributedBody")))).alias("text"), "sender", ca.apple_time_us(F.col("date")).alias("timestamp_us"), ca.apple_time_precision(F.col("date")).alias("timestamp_precision"),
        (F.col("is_from_me") == 1).alias("is_outgoing"), "service", F.col("thread_originator_guid").alias("reply_to_guid"), F.coalesce("conversations", orphan).alias("conversations"), "attachments",
    )
