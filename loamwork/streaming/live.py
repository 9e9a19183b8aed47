"""Requests and confirmations as streams with state that outlives restarts: each key's state is a few values, and a timer of event time removes it.

    answered = live.answer(spark.readStream...., "request_key", 3600)
    live.run(answered, out, checkpoint)     # all that is there, then it ends; the same again goes on where this ended

A key's rows of one micro-batch are put in order within its task; how much a micro-batch brings is bounded where the stream is read
(maxFilesPerTrigger, maxBytesPerTrigger). Rows must come in order of time up to the watermark's delay: later ones are dropped.
The same functions take batch DataFrames, and then give what one micro-batch of all rows would.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from loamwork import session

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ISSUE, CONFIRM = "issue", "confirm"


class _Kept(StatefulProcessor):
    """State of one value for each key, which goes when event time passes `until`."""

    SCHEMA = ""

    def __init__(self, seconds: float) -> None:
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", self.SCHEMA)

    def step(self, now: tuple | None, row) -> tuple[tuple | None, tuple]:
        """(state after the row, what the row gives)."""
        raise NotImplementedError

    def names(self) -> list[str]:
        raise NotImplementedError

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(["at_us", "event_id"])
        now = self.kept.get() if self.kept.exists() else None
        before, out = now, []
        for row in pdf.itertuples():
            now, given = self.step(now, row)
            out.append((key[0], row.event_id, *given))
        if now is not None and now != before:
            self.kept.update(now)
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(int(now[0] / 1000 + self.seconds * 1000) + 1)
        yield pd.DataFrame(out, columns=["key", "event_id", *self.names()])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.kept.clear()
        yield pd.DataFrame(columns=["key", "event_id", *self.names()])

    def close(self) -> None:
        pass


class _Requests(_Kept):
    SCHEMA = "at_us long, first long"

    def names(self) -> list[str]:
        return ["answer_of"]

    def step(self, now, row):
        if now is None or row.at_us - now[0] > self.seconds * 1e6:
            now = (int(row.at_us), int(row.event_id))
        return now, (now[1],)


class _Tokens(_Kept):
    SCHEMA = "at_us long, used boolean"

    def names(self) -> list[str]:
        return ["accepted"]

    def step(self, now, row):
        if row.kind == ISSUE:
            return (int(row.at_us), False), (None,)
        good = now is not None and not now[1] and 0 <= row.at_us - now[0] <= self.seconds * 1e6
        return ((now[0], True) if good else now), (good,)


def _with(df: DataFrame, key: str, ts: str, delay: str, columns: list[str], processor: _Kept, schema: str) -> DataFrame:
    session.ship(df.sparkSession)
    rows = df.select(F.col(key).cast("string").alias("key"), F.col("event_id").cast("long").alias("event_id"), F.col(ts).cast("timestamp").alias("at"), *columns)
    rows = rows.withColumn("at_us", F.unix_micros("at")).withWatermark("at", delay)
    return rows.groupBy("key").transformWithStateInPandas(processor, f"key string, event_id long, {schema}", "append", "eventTime")


def answer(requests: DataFrame, key: str, seconds: float, ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """(key, event_id, answer_of) of requests (key, event_id, ts): a request is answered by itself if its key has none of the last `seconds`, else by that one."""
    return _with(requests, key, ts, delay, [], _Requests(seconds), "answer_of long")


def confirmations(events: DataFrame, key: str, seconds: float = 300, ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """(key, event_id, accepted) of events (key, event_id, ts, kind): a token is issued, and confirmed once, up to `seconds` after; accepted is null for issues.
    What is issued again counts from then."""
    return _with(events, key, ts, delay, ["kind"], _Tokens(seconds), "accepted boolean")


def run(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Writes what the stream has so far to Parquet files at `out` and ends; states and what was read are kept at `checkpoint`."""
    spark, name = stream.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, STORE)
    try:
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
