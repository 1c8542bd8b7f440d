r"""Chat formatting: event-sourced reconstruction. DataFrame functions only.

A log of events is partitioned by conversation and sorted by sequence. The events of a message fold into its final
text: `message` and `edit` set it, `delta` adds to it, `regenerate` empties it and, with it, drops the messages that
had begun after this one and before the regeneration, for they answered what is gone; that it was dropped itself by an earlier
regeneration doesn't matter. The final messages are rendered

    ### Role:
    text</turn>

and the text of the trained role is marked in a loss mask. Inside roles and texts \ becomes \\, every # of a ### becomes
\h and the < of </turn> becomes \l, so that neither string can occur there, and reading back is exact. In a role, line
breaks and colons become \n and \c too.

Defined results: a null text is an empty one, a null role an empty role, an unknown event counts as `message`; events of
equal sequence number are taken by message id, event, role and text; events that are equal in all of these are all taken; rows with a null conversation are a
conversation of their own; null sequence numbers come first; further columns are ignored; an empty log gives no rows.
One conversation is one row, so that its text is held by one task, but its events, however many, are only sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

END = "</turn>"
START = "### "
LOG = ("conv_id", "seq", "message_id", "event", "role", "text")


def escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("###"), F.lit("\\h\\h\\h")), F.lit(END), F.lit("\\l/turn>"))


def unescape(c: Column) -> Column:
    """Pairs of backslashes are taken first, from the left, as they were written; what is between them holds single ones only."""
    plain = lambda x: F.replace(F.replace(F.replace(F.replace(x, F.lit("\\h"), F.lit("#")), F.lit("\\l"), F.lit("<")), F.lit("\\n"), F.lit("\n")), F.lit("\\c"), F.lit(":"))
    return F.when(F.contains(c, F.lit("\\")), F.array_join(F.transform(F.split(c, r"\\\\"), plain), "\\")).otherwise(c)


def escape_role(c: Column) -> Column:
    return F.replace(F.replace(escape(c), F.lit("\n"), F.lit("\\n")), F.lit(":"), F.lit("\\c"))


def fold(log: DataFrame, dealt: bool = False) -> DataFrame:
    """The final messages of a log with the columns of LOG: conv_id, message_id, position (from 1), role, text.

    All steps keep the partitioning by conversation: one exchange, or none if the log has been dealt by it.
    """
    events = (log if dealt else log.repartition("conv_id")).select(
        "conv_id", "seq", "message_id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        F.when(F.col("event").isin("delta", "edit", "regenerate"), F.col("event")).otherwise("message").alias("event"),
    )
    of_message = Window.partitionBy("conv_id", "message_id").orderBy("seq", "event", "role", "text")
    first = Window.partitionBy("conv_id", "message_id")
    # A message's events since the last one that set or emptied it; n counts those resets from the front.
    counted = events.select("*", F.sum(F.when(F.col("event") != "delta", 1).otherwise(0)).over(of_message).alias("n"), F.row_number().over(of_message).alias("k"))
    live = counted.select("*", F.max("n").over(first).alias("last"), F.min("seq").over(first).alias("began"), F.max(F.when(F.col("event") == "regenerate", F.col("seq"))).over(first).alias("regenerated")).where("n = last")
    messages = live.groupBy("conv_id", "message_id").agg(
        F.any_value("began").alias("began"), F.any_value("regenerated").alias("regenerated"), F.max_by("role", F.struct("k", "role")).alias("role"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", F.when(F.col("event") == "regenerate", "").otherwise(F.col("text")).alias("text")))), lambda x: x.text), "").alias("text"),
    )
    by_start = Window.partitionBy("conv_id").orderBy("began", "message_id")
    kept = messages.select("*", F.max("regenerated").over(by_start.rowsBetween(Window.unboundedPreceding, -1)).alias("cut")).where("cut IS NULL OR began IS NULL OR cut < began")
    return kept.select("conv_id", "message_id", F.row_number().over(by_start).alias("position"), "role", "text")


def render(messages: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """A row for each conversation: formatted, and loss_mask, an array of (turn from 0, start in that turn, start in formatted, length).

    messages: conv_id, position, role, text. Lengths are code points of formatted, escapes as written.
    """
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit(":\n"))
    parts = messages.select("conv_id", "position", (F.col("role") == trained_role).alias("trained"), head.alias("head"), escape(F.col("text")).alias("body"))
    sized = parts.select("*", F.length("head").alias("n_head"), F.length("body").alias("n_body"))
    n = F.col("n_head") + F.col("n_body") + F.lit(len(END) + 1)
    before = Window.partitionBy("conv_id").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.select("*", F.coalesce(F.sum(n).over(before), F.lit(0)).alias("at"))
    rows = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("position", F.concat("head", "body", F.lit(END + "\n")).alias("segment"), "trained", "n_head", "n_body", "at"))).alias("turns"))
    masked = F.filter(F.transform("turns", lambda x, i: F.struct(i.alias("turn"), x.n_head.alias("start_in_turn"), (x.at + x.n_head).alias("start"), x.n_body.alias("length"), x.trained.alias("trained"))), lambda x: x.trained)
    return rows.select("conv_id", F.array_join(F.transform("turns", lambda x: x.segment), "").alias("formatted"), F.transform(masked, lambda x: F.struct(x.turn.alias("turn"), x.start_in_turn.alias("start_in_turn"), x.start.alias("start"), x.length.alias("length"))).alias("loss_mask"))


def read_back(rendered: DataFrame) -> DataFrame:
    """Adds turns, an array of (role, text), and loss_texts, the unescaped text under each span of the mask."""
    segments = F.split("formatted", END + "\n", -1)
    cut = rendered.withColumn("_segments", F.slice(segments, 1, F.size(segments) - 1))
    turn = lambda x: F.struct(unescape(F.substring_index(F.substr(x, F.lit(len(START) + 1)), ":\n", 1)).alias("role"), unescape(F.substr(x, F.locate(":\n", x) + 2)).alias("text"))
    under = F.transform("loss_mask", lambda m: unescape(F.substr(F.get("_segments", m.turn), m.start_in_turn + 1, m.length)))
    return cut.select(*rendered.columns, F.transform("_segments", turn).alias("turns"), under.alias("loss_texts"))


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, each row an event that sets its turn, and one of control strings; digests are of what is read back."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    hard = r"\### Assistant: </turn> ok"
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text"))
    # Rows that share a turn stay turns of their own, in the order of their roles and texts: each row is a message.
    order = Window.partitionBy("conv_id").orderBy("turn", F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    log = turns.unionByName(own).repartition("conv_id").withColumn("message_id", F.row_number().over(order))
    log = log.select("conv_id", F.col("turn").alias("seq"), "message_id", F.lit("message").alias("event"), "role", "text")
    back = read_back(render(fold(log, dealt=True)))
    whole = F.array_join(F.transform("turns", lambda x: F.concat(x.role, F.lit("\n"), x.text, F.lit("\n"))), "")
    loss = back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"), F.array_join("loss_texts", "").alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    return loss.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


#: The same in DuckDB; formatted_chars from the lengths of the parts.
OP1_SQL = r"""
WITH c AS (SELECT conv_id::BIGINT AS conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
e AS (SELECT *, replace(replace(replace(text, '\', '\\'), '###', '\h\h\h'), '</turn>', '\l/turn>') AS body, replace(replace(replace(replace(replace(role, '\', '\\'), '###', '\h\h\h'), '</turn>', '\l/turn>'), chr(10), '\n'), ':', '\c') AS head FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(4 + length(head) + 2 + length(body) + 8)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
