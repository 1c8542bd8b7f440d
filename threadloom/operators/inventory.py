"""A chat database's tables against the records that came of them: each row is explained, and each record has its source.

source: message (ROWID), chat_message_join (ROWID, message_id, chat_id), attachment (ROWID), message_attachment_join (ROWID,
message_id, attachment_id). emitted: message_id, conversation_id, conversations (array of structs key, chat_id, the chat null
for a conversation of a message without one), attachments (array of attachment ids, as often as they are linked); a null
array is an empty one. errors: message_id of records that couldn't be written; what hangs on these is accounted for.

The account has a row for each row of the four tables and for each thing emitted that has no source: table_name, row_id,
message_id, other_id (chat or attachment), outcome (emitted, error, duplicate, unsupported, lost, unfounded) and reason, null
where nothing is amiss. Every join is on a key of its own; copies are counted, never multiplied.

Rows are a few ids, which take ten times as much memory in a sort as in a shuffle; so they are dealt over as many tasks as
their number needs, and not over as few as their bytes would fill.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COLUMNS = ("table_name", "row_id", "message_id", "other_id", "outcome", "reason")
#: Outcomes that are faults: the others are explained.
FAULTS = ("lost", "unfounded", "doubled")
#: Rows of a database's tables for a task.
TASK_ROWS = 250_000


def tasks(*tables: DataFrame) -> int:
    return max(1, -(-sum(t.count() for t in tables) // TASK_ROWS))


def _rows(df: DataFrame, table: str, row_id: Column | str, other: Column | None = None) -> DataFrame:
    """df (with message_id, outcome and reason) as rows of the account."""
    none = F.lit(None).cast("bigint")
    return df.select(F.lit(table).alias("table_name"), (F.col(row_id) if isinstance(row_id, str) else row_id).alias("row_id"), "message_id", (none if other is None else other).alias("other_id"), "outcome", "reason")


def _judged(df: DataFrame, *cases: tuple[Column, str, str | None]) -> DataFrame:
    """df with the outcome and reason of the first case that holds."""
    outcome, reason = F.lit(None).cast("string"), F.lit(None).cast("string")
    for when, o, r in reversed(cases):
        outcome, reason = F.when(when, F.lit(o)).otherwise(outcome), F.when(when, F.lit(r).cast("string")).otherwise(reason)
    return df.withColumn("outcome", outcome).withColumn("reason", reason)


def message_account(message: DataFrame, emitted: DataFrame, errors: DataFrame) -> DataFrame:
    """Each message is emitted or an error, once."""
    n_tasks = tasks(message)
    told = emitted.select("message_id", F.lit(1).alias("e"), F.lit(0).alias("x")).union(errors.select("message_id", F.lit(0), F.lit(1)))
    counts = told.where("message_id IS NOT NULL").repartition(n_tasks, "message_id").groupBy("message_id").agg(F.sum("e").alias("e"), F.sum("x").alias("x"))
    both = message.select(F.col("ROWID").alias("message_id"), F.lit(True).alias("here")).repartition(n_tasks, "message_id").join(counts, "message_id", "full")
    here, n = F.col("here").isNotNull(), F.coalesce(F.col("e") + F.col("x"), F.lit(0))
    return _rows(_judged(
        both, (~here, "unfounded", "MESSAGE_WITHOUT_SOURCE"), (n == 0, "lost", "MESSAGE_LOST"), (n > 1, "doubled", "MESSAGE_TWICE"), (F.col("x") > 0, "error", None), (F.lit(True), "emitted", None),
    ), "message", "message_id")


def _linked(links: DataFrame, message: DataFrame, other: str, n_tasks: int) -> DataFrame:
    """Rows of a join table with `known`: whether their message exists."""
    ids = message.select(F.col("ROWID").alias("message_id"), F.lit(True).alias("known")).repartition(n_tasks, "message_id")
    return links.select("ROWID", "message_id", F.col(other).alias("other_id")).repartition(n_tasks, "message_id").join(ids, "message_id", "left")


def _conversations(emitted: DataFrame) -> DataFrame:
    return emitted.select("message_id", F.explode("conversations").alias("c")).select("message_id", F.col("c.key").alias("key"), F.col("c.chat_id").alias("other_id")).where("message_id IS NOT NULL")


def conversation_account(message: DataFrame, links: DataFrame, emitted: DataFrame, errors: DataFrame) -> DataFrame:
    """Each pair of a message and a chat once, the first row of equal ones; and each message of no chat in a conversation of its own."""
    n_tasks = tasks(message, links)
    by_message = lambda df: df.repartition(n_tasks, "message_id")
    by_pair = lambda df: df.repartition(n_tasks, "message_id", "other_id")
    rows = _linked(links, message, "chat_id", n_tasks)
    sound = F.col("message_id").isNotNull() & F.col("other_id").isNotNull() & F.col("known").isNotNull()
    first = F.row_number().over(Window.partitionBy("message_id", "other_id", sound).orderBy("ROWID")) == 1
    numbered = rows.withColumn("sound", sound).withColumn("first", first)
    named = _conversations(emitted)
    actual = by_pair(named.where("other_id IS NOT NULL").select("message_id", "other_id")).distinct().withColumn("out", F.lit(True))
    failed = by_message(errors.select("message_id").where("message_id IS NOT NULL")).distinct().withColumn("failed", F.lit(True))
    pairs = by_message(by_pair(numbered.where("sound AND first").select("ROWID", "message_id", "other_id")).join(actual, ["message_id", "other_id"], "full")).join(failed, "message_id", "left")
    main = _judged(pairs, (F.col("ROWID").isNull(), "unfounded", "CONVERSATION_WITHOUT_SOURCE"), (F.col("out").isNotNull(), "emitted", None), (F.col("failed").isNotNull(), "error", None), (F.lit(True), "lost", "CONVERSATION_LOST"))
    rest = _judged(
        numbered.where("NOT (sound AND first)"), (F.col("message_id").isNull() | F.col("other_id").isNull(), "unsupported", "ID_MISSING"), (F.col("known").isNull(), "unsupported", "MESSAGE_MISSING"), (F.lit(True), "duplicate", "SAME_RELATION"),
    )
    # Messages of no chat: a conversation of their own, and none of those that have one.
    alone = by_message(message.select(F.col("ROWID").alias("message_id"))).join(numbered.where("sound").select("message_id").distinct(), "message_id", "left_anti").withColumn("alone", F.lit(True))
    own = by_message(named.where(F.col("other_id").isNull() & (F.col("key") == F.concat(F.lit("orphan:"), F.col("message_id").cast("string")))).select("message_id")).distinct().withColumn("out", F.lit(True))
    orphans = _judged(
        alone.join(own, "message_id", "full").join(failed, "message_id", "left"), (F.col("alone").isNull(), "unfounded", "ORPHAN_WITHOUT_SOURCE"), (F.col("out").isNotNull(), "emitted", None), (F.col("failed").isNotNull(), "error", None), (F.lit(True), "lost", "ORPHAN_LOST"),
    )
    none = F.lit(None).cast("bigint")
    return _rows(main, "chat_message_join", "ROWID", F.col("other_id")).union(_rows(rest, "chat_message_join", "ROWID", F.col("other_id"))).union(_rows(orphans, "orphan", none))


def primary_account(emitted: DataFrame) -> DataFrame:
    """Records whose conversation is not the first of their conversations."""
    wrong = emitted.where(F.col("message_id").isNotNull() & (F.size(F.coalesce("conversations", F.array())) > 0) & ~F.col("conversation_id").eqNullSafe(F.get("conversations", F.lit(0))["key"]))
    return _rows(wrong.select("message_id", F.lit("unfounded").alias("outcome"), F.lit("PRIMARY_CONVERSATION_DIFFERS").alias("reason")), "record", F.lit(None).cast("bigint"))


def attachment_account(message: DataFrame, attachment: DataFrame, links: DataFrame, emitted: DataFrame, errors: DataFrame) -> DataFrame:
    """Each link as often as it is there, and each attachment that no sound link has."""
    n_tasks = tasks(message, links, attachment)
    dealt = lambda df, *keys: df.repartition(n_tasks, *keys)
    ids = dealt(attachment.select(F.col("ROWID").alias("other_id"), F.lit(True).alias("held")), "other_id")
    rows = dealt(_linked(links, message, "attachment_id", n_tasks), "other_id").join(ids, "other_id", "left")
    judged = _judged(rows, (F.col("message_id").isNull() | F.col("other_id").isNull(), "unsupported", "ID_MISSING"), (F.col("known").isNull(), "unsupported", "MESSAGE_MISSING"), (F.col("held").isNull(), "unsupported", "ATTACHMENT_MISSING"))
    sound = dealt(judged.where("outcome IS NULL"), "message_id", "other_id").select("ROWID", "message_id", "other_id", F.row_number().over(Window.partitionBy("message_id", "other_id").orderBy("ROWID")).alias("n"))
    out = emitted.where("message_id IS NOT NULL").select("message_id", F.explode("attachments").alias("other_id")).where("other_id IS NOT NULL")
    out = dealt(out, "message_id", "other_id").select("message_id", "other_id", F.row_number().over(Window.partitionBy("message_id", "other_id").orderBy(F.lit(1))).alias("n"), F.lit(True).alias("out"))
    failed = dealt(errors.select("message_id"), "message_id").join(dealt(emitted.select("message_id"), "message_id"), "message_id", "left_anti").distinct().withColumn("failed", F.lit(True))
    # The n-th link of a pair against its n-th attachment in the record.
    main = _judged(
        dealt(dealt(sound, "message_id", "other_id", "n").join(dealt(out, "message_id", "other_id", "n"), ["message_id", "other_id", "n"], "full"), "message_id").join(failed, "message_id", "left"), (F.col("ROWID").isNull(), "unfounded", "ATTACHMENT_WITHOUT_SOURCE"), (F.col("out").isNotNull(), "emitted", None), (F.col("failed").isNotNull(), "error", None), (F.lit(True), "lost", "ATTACHMENT_LOST"),
    )
    used = judged.where("other_id IS NOT NULL").groupBy("other_id").agg(F.max(F.col("outcome").isNull()).alias("sound"))
    idle = attachment.select(F.col("ROWID").alias("other_id")).join(used, "other_id", "left").where("NOT coalesce(sound, false)")
    idle = _judged(idle.withColumn("message_id", F.lit(None).cast("bigint")), (F.col("sound").isNotNull(), "unsupported", "ONLY_UNSUPPORTED_LINKS"), (F.lit(True), "unsupported", "NO_LINK"))
    parts = [(main, "message_attachment_join", F.col("ROWID"), F.col("other_id")), (judged.where("outcome IS NOT NULL"), "message_attachment_join", F.col("ROWID"), F.col("other_id")), (idle, "attachment", F.col("other_id"), None)]
    a, b, c = (_rows(df, table, row, other) for df, table, row, other in parts)
    return a.union(b).union(c)


def source_account(source: dict[str, DataFrame], emitted: DataFrame, errors: DataFrame) -> DataFrame:
    """The whole account."""
    message = source["message"]
    parts = (
        message_account(message, emitted, errors), conversation_account(message, source["chat_message_join"], emitted, errors), primary_account(emitted),
        attachment_account(message, source["attachment"], source["message_attachment_join"], emitted, errors),
    )
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.select(*COLUMNS)


def account_summary(account: DataFrame) -> DataFrame:
    """table_name, outcome, reason and n; `ok` is false for faults."""
    return account.groupBy("table_name", "outcome", "reason").agg(F.count("*").alias("n")).withColumn("ok", ~F.col("outcome").isin(*FAULTS))
