"""Stateful operators over event streams: token buckets, circuit breaker, idempotent requests, counters; and the polling ingest job."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loamwork import session

# Calls a second, burst; failures that open the breaker, seconds until it tries again.
RPS, BURST, FAILURES, OPEN_SECONDS = 10.0, 20, 5, 30.0


def bucket(times: Sequence[float], left: float | None = None, last: float | None = None, rps: float = RPS, burst: float = BURST) -> tuple[list[bool], float, float | None]:
    """Which calls at rising times find a token in a bucket that starts full, what is left in it, and when that was.

    Between two calls the bucket gains rps tokens a second, up to burst; a call takes one if there is one.
    """
    left = burst if left is None else left
    gains = np.diff(np.array(times, float), prepend=times[0] if last is None and len(times) else last or 0.0)
    taken = []
    for gain in np.maximum(gains, 0.0) * rps:
        level = min(burst, left + gain)
        taken.append(bool(level >= 1))
        left = level - taken[-1]
    return taken, left, times[-1] if len(times) else last


#: A breaker is (state, failures in a row, since when it is open).
CLOSED = ("CLOSED", 0, 0.0)


def after(now: float, ok: bool, at: tuple[str, int, float], failures: int = FAILURES, seconds: float = OPEN_SECONDS) -> tuple[bool, tuple[str, int, float]]:
    """Whether a call at `now` is let through, and the breaker after its result.

    OPEN refuses for `seconds` and then lets a trial through; a success closes the breaker; the failure that makes `failures` in a row (a trial's always does) opens it.
    """
    state, count, since = at
    if state == "OPEN" and now - since <= seconds:
        return False, at
    if ok:
        return True, CLOSED
    return True, ("OPEN", count + 1, now) if count + 1 >= failures else (state, count + 1, since)


def _seconds(ts: pd.Series) -> list[float]:
    return [t.timestamp() for t in ts]


def limit(events: DataFrame, keys: list[str], rps: float = RPS, burst: float = BURST) -> DataFrame:
    """Batch or stream of events (keys, ts, event_id) with `allowed` by a token bucket for each key. A stream keeps the buckets as state."""
    session.ship(events.sparkSession)
    names = ", ".join(f"{k} {events.schema[k].dataType.simpleString()}" for k in keys)
    out = f"event_id long, {names}, allowed boolean"

    def run(pdf: pd.DataFrame, *state: float) -> tuple[pd.DataFrame, tuple]:
        pdf = pdf.sort_values(["ts", "event_id"])
        allowed, *now = bucket(_seconds(pdf["ts"]), *(state or (None, None)), rps, burst)
        return pd.DataFrame({"event_id": pdf["event_id"].to_numpy(), **{k: pdf[k].to_numpy() for k in keys}, "allowed": allowed}), tuple(now)

    if not events.isStreaming:
        return events.groupBy(*keys).applyInPandas(lambda pdf: run(pdf)[0], out)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows, now = run(pd.concat(list(parts)), *(state.get if state.exists else ()))
        yield rows
        state.update(now)

    return events.groupBy(*keys).applyInPandasWithState(step, out, "tokens double, at double", "append", GroupStateTimeout.NoTimeout)


def breaker(events: DataFrame, key: str, failures: int = FAILURES, seconds: float = OPEN_SECONDS) -> DataFrame:
    """Events (key, ts, event_id, ok) with `allowed` and the breaker's state after each: one breaker for each key."""
    session.ship(events.sparkSession)
    kind = events.schema[key].dataType.simpleString()
    out = f"event_id long, {key} {kind}, allowed boolean, state string"

    def run(pdf: pd.DataFrame, now: tuple = CLOSED) -> tuple[pd.DataFrame, tuple]:
        pdf = pdf.sort_values(["ts", "event_id"])
        allowed, states = [], []
        for t, ok in zip(_seconds(pdf["ts"]), pdf["ok"], strict=True):
            through, now = after(t, bool(ok), now, failures, seconds)
            allowed.append(through)
            states.append(now[0])
        return pd.DataFrame({"event_id": pdf["event_id"].to_numpy(), key: pdf[key].to_numpy(), "allowed": allowed, "state": states}), now

    if not events.isStreaming:
        return events.groupBy(key).applyInPandas(lambda pdf: run(pdf)[0], out)

    def step(name: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows, now = run(pd.concat(list(parts)), state.get if state.exists else CLOSED)
        yield rows
        state.update(now)

    return events.groupBy(key).applyInPandasWithState(step, out, "state string, count int, since double", "append", GroupStateTimeout.NoTimeout)


def guarded(events: DataFrame, keys: list[str], breaker_key: str, rps: float = RPS, burst: float = BURST, failures: int = FAILURES, seconds: float = OPEN_SECONDS) -> DataFrame:
    """The order of guards: the breaker of each breaker_key (a tool, say) first, then the buckets of calls that it lets through."""
    through = breaker(events, breaker_key, failures, seconds).where("allowed").select("event_id")
    return limit(events.join(through, "event_id", "left_semi"), keys, rps, burst)


def once(requests: DataFrame, key: str = "request_key", ts: str = "ts", within: str = "1 day") -> DataFrame:
    """The first of requests with equal keys: over all of a batch, and over a stream within the watermark."""
    return requests.withWatermark(ts, within).dropDuplicatesWithinWatermark([key]) if requests.isStreaming else requests.dropDuplicates([key])


def counters(events: DataFrame, *by: str) -> DataFrame:
    """Running counts and sums; in a stream with outputMode('complete') or 'update'."""
    return events.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def with_retries(job: Callable[[], object], attempts: int = 3, backoff: float = 1.5, sleep: Callable[[float], None] = time.sleep) -> tuple[object, int]:
    """Result and number of retries; waits backoff * 2 ** (attempt - 1) between attempts, and raises the last error."""
    for attempt in range(1, attempts + 1):
        try:
            return job(), attempt - 1
        except Exception:
            if attempt == attempts:
                raise
            sleep(backoff * 2 ** (attempt - 1))
    raise ValueError("attempts must be positive")


def auto_ingest(stream: DataFrame, full: Callable[[DataFrame], None], part: Callable[[DataFrame], None], checkpoint: str, every: int = 8, interval: str | None = "900 seconds", attempts: int = 3, backoff: float = 1.5):
    """A streaming query that hands each batch of new files to `part`, and at the start and each `every` batches to `full`; failures are retried."""

    def batch(df: DataFrame, number: int) -> None:
        with_retries(lambda: (full if number % every == 0 else part)(df), attempts, backoff)

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()
