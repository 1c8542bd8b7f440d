"""Turns of a stream of messages, closed when nothing can be added to them any more.

Each conversation keeps the messages that the watermark hasn't passed, and the turn that is open. When the watermark passes
messages they are final: they are taken in the order of a batch and put to the open turn, or close it where the sender
changes or the gap ends the session. A turn also closes when the watermark is so far beyond its last message that any
further one would begin a new session. So whatever the order in which messages arrive within the watermark, the turns are
those of a batch over the messages of known time. A message that comes when its conversation has been settled beyond its
time can't be put in its place: it comes out as it is, of kind "late", and changes nothing.

State is bounded by the messages of a conversation within the watermark's delay and one open turn; the ids of a turn's
messages are part of it. It needs the RocksDB state store: `with_rocksdb` sets it for a session.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..config import DEFAULT, Config
from ..operators.structure import calendar, text_features
from . import timed

COUNTS = ("word_count", "char_count", "question_count", "exclamation_count", "affection_count", "negative_count")
MESSAGE = "timestamp_us bigint, source_order bigint, source_message_id string, message_id bigint, membership_id bigint, sender_id bigint, period_date date, " + ", ".join(f"{c} bigint" for c in COUNTS)
#: turn_no and session_no count what was closed or is open; settled_us is how far messages are final.
OPEN = "settled_us bigint, turn_no bigint, session_no bigint, sender_id bigint, start_us bigint, end_us bigint, period_date date, message_count bigint, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", message_ids array<bigint>"
TURN = "kind string, conversation_id bigint, turn_no bigint, session_no bigint, participant_id bigint, message_count bigint, start_us bigint, end_us bigint, period_date date, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", message_ids array<bigint>"
_MESSAGE = [f.split()[0] for f in MESSAGE.split(", ")]
_WHOLE = {f.split()[0] for f in MESSAGE.split(", ") if f.endswith("bigint")}
_OPEN = [f.split()[0] for f in OPEN.split(", ")]
_TURN = [f.split()[0] for f in TURN.split(", ")]


def with_rocksdb(spark: SparkSession) -> None:
    """State of several variables and timers needs this store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def plain(name: str, v):
    """A value as the state has it. Whole numbers come as text: pandas would make those beside nulls floats of 53 bits."""
    if v is None or v is pd.NaT or v != v:
        return None
    return int(v) if name in _WHOLE else v


class TurnProcessor(StatefulProcessor):
    def __init__(self, gap_us: int):
        self.gap_us = gap_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", MESSAGE)
        self.open = handle.getValueState("open", OPEN)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state, late, new = self._state(), [], []
        for frame in rows:
            for values in zip(*(frame[c] for c in _MESSAGE), strict=True):
                m = {c: plain(c, v) for c, v in zip(_MESSAGE, values, strict=True)}
                (late if state and m["timestamp_us"] < state["settled_us"] else new).append(m)
        out = [{"kind": "late", "conversation_id": key[0], "participant_id": m["sender_id"], "message_count": 1, "start_us": m["timestamp_us"], "end_us": m["timestamp_us"], "period_date": m["period_date"], "message_ids": [m["message_id"]], **{c: m[c] for c in COUNTS}} for m in late]
        yield self._frame(out + self._settle(key, state, new, timerValues.getCurrentWatermarkInMs() * 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._frame(self._settle(key, self._state(), [], timerValues.getCurrentWatermarkInMs() * 1000))

    def _state(self) -> dict | None:
        return dict(zip(_OPEN, self.open.get(), strict=True)) if self.open.exists() else None

    def _frame(self, turns: list[dict]) -> pd.DataFrame:
        return pd.DataFrame({c: pd.Series([t.get(c) for t in turns], dtype="object" if c in ("kind", "period_date", "message_ids") else "Int64") for c in _TURN})

    def _settle(self, key, state: dict | None, new: list[dict], settled: int) -> list[dict]:
        """Takes what is before `settled` in order, keeps the rest, and sets the next timer. Returns the turns that are closed."""
        held = [dict(zip(_MESSAGE, m, strict=True)) for m in self.waiting.get()] + new
        last = lambda v: (v is None, v or 0)
        held.sort(key=lambda m: (m["timestamp_us"], last(m["source_order"]), (m["source_message_id"] or "").encode(), last(m["message_id"]), last(m["membership_id"])))
        ready = [m for m in held if m["timestamp_us"] < settled]
        held = held[len(ready) :]
        closed = []
        state = state or {"settled_us": settled, "turn_no": 0, "session_no": 0, "end_us": None, "message_count": 0}
        state["settled_us"] = max(settled, state["settled_us"])
        for m in ready:
            session = state["end_us"] is None or m["timestamp_us"] - state["end_us"] > self.gap_us
            if session or not state["message_count"] or m["sender_id"] != state["sender_id"]:
                closed += self._close(key, state)
                state |= {"turn_no": state["turn_no"] + 1, "session_no": state["session_no"] + session, "sender_id": m["sender_id"], "start_us": m["timestamp_us"], "period_date": m["period_date"], "message_ids": [], **dict.fromkeys(COUNTS, 0)}
            state |= {"end_us": m["timestamp_us"], "message_count": state["message_count"] + 1, "message_ids": [*state["message_ids"], m["message_id"]], **{c: state[c] + (m[c] or 0) for c in COUNTS}}
        if state["end_us"] is not None and settled > state["end_us"] + self.gap_us:
            closed += self._close(key, state)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        due = [m["timestamp_us"] for m in held[:1]] + ([state["end_us"] + self.gap_us] if state["message_count"] else [])
        if due:
            self.handle.registerTimer(min(due) // 1000 + 1)
        self.waiting.put([tuple(m[c] for c in _MESSAGE) for m in held]) if held else self.waiting.clear()
        self.open.update(tuple(state.get(c) for c in _OPEN))
        return closed

    def _close(self, key, state: dict) -> list[dict]:
        """The open turn, if there is one; the conversation goes on counting from it."""
        if not state["message_count"]:
            return []
        turn = {"kind": "turn", "conversation_id": key[0], "participant_id": state["sender_id"], **{c: state[c] for c in ("turn_no", "session_no", "message_count", "start_us", "end_us", "period_date", *COUNTS, "message_ids")}}
        state |= {"message_count": 0, "message_ids": [], "sender_id": None}
        return [turn]

    def close(self) -> None:
        pass


def turns(stream: DataFrame, config: Config = DEFAULT, delay: str = "1 day") -> DataFrame:
    """Rows of kind "turn", with the columns of a batch's turns, and of kind "late": messages that came too late. Messages of
    unknown time are for `streaming.untimed`: a batch gives each of them a turn after all others."""
    known = timed(text_features(calendar(stream), config).withColumn("period_date", F.coalesce("local_date", "utc_date")), delay)
    # Without the column of event times in it Spark doesn't drop late rows unseen.
    rows = known.select(F.col("conversation_id").cast("bigint").alias("conversation_id"), *[F.col(c).cast("string" if c in _WHOLE else t).alias(c) for c, t in (f.split() for f in MESSAGE.split(", "))])
    return rows.groupBy("conversation_id").transformWithStateInPandas(statefulProcessor=TurnProcessor(config.session_gap_seconds * 1_000_000), outputStructType=TURN, outputMode="Append", timeMode="EventTime")
