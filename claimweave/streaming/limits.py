"""Rate limits and caches with expiry over request sequences, in batch and as streams.

Rejected requests do not count and hits do not extend an entry, so the state is recursive: it is carried
through each key's requests in order. Batch jobs deal the requests out by key and sort them within their
partition; a key's state is a few times, so a hot key costs time but no memory.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

DAY_MS = 86_400_000


def _scan(df: DataFrame, key: str, ts: str, tie: str, name: str, step) -> DataFrame:
    """``df`` (key, ts, tie) with the boolean ``name`` that ``step(state, ms) -> (state, flag)`` gives in order."""
    rows = df.select(F.col(key).cast("string").alias("k"), F.unix_millis(F.col(ts).cast("timestamp")).alias("ms"), F.col(tie).cast("long").alias("id"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = object(), None
        for pdf in batches:
            flags = []
            for k, ms in zip(pdf["k"].tolist(), pdf["ms"].tolist()):
                if k != last:
                    last, state = k, None
                state, flag = step(state, ms)
                flags.append(flag)
            yield pd.DataFrame({"id": pdf["id"], name: flags})

    flags = rows.repartition("k").sortWithinPartitions("k", "ms", "id").mapInPandas(run, f"id long, {name} boolean")
    return flags.withColumnRenamed("id", tie)


def rate_limit_step(limit: int, window_ms: int):
    def step(state, ms: int):
        times = state or deque()
        while times and ms - times[0] >= window_ms:
            times.popleft()
        if len(times) >= limit:
            return times, False
        times.append(ms)
        return times, True

    return step


def cache_step(ttl_ms: int):
    def step(state, ms: int):
        if state is not None and ms <= state:
            return state, True
        return ms + ttl_ms, False

    return step


def rate_limited(df: DataFrame, key: str, ts: str, tie: str, limit: int, window_ms: int) -> DataFrame:
    """Rows (tie, allowed): at most ``limit`` allowed requests of a key in any window."""
    return _scan(df, key, ts, tie, "allowed", rate_limit_step(limit, window_ms))


def cache_hits(df: DataFrame, key: str, ts: str, tie: str, ttl_ms: int) -> DataFrame:
    """Rows (tie, hit): a miss stores an entry for ``ttl_ms``, a hit does not extend it."""
    return _scan(df, key, ts, tie, "hit", cache_step(ttl_ms))


class _Limiter(StatefulProcessor):
    """Allowed times of a key, which go when the last of them leaves the window."""

    def __init__(self, limit: int, window_ms: int):
        self.limit, self.window_ms = limit, window_ms

    def init(self, handle) -> None:
        self.handle, self.times = handle, handle.getValueState("times", "times array<bigint>, timer bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.times.get() if self.times.exists() else None
        times, timer = (deque(held[0]), held[1]) if held else (deque(), None)
        step = rate_limit_step(self.limit, self.window_ms)
        ordered, flags = pd.concat(list(rows)).sort_values(["ms", "id"]), []
        for ms in ordered["ms"].tolist():
            times, flag = step(times, ms)
            flags.append(flag)
        if timer is not None:
            self.handle.deleteTimer(timer)
        if times:
            timer = int(times[-1]) + self.window_ms
            self.times.update(([int(t) for t in times], timer))
            self.handle.registerTimer(timer)
        else:
            self.times.clear()
        yield pd.DataFrame({"id": ordered["id"], "allowed": flags})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.times.clear()
        yield pd.DataFrame({"id": pd.Series([], dtype="int64"), "allowed": pd.Series([], dtype=bool)})

    def close(self) -> None:
        pass


@contextmanager
def rocks_states(spark: SparkSession):
    """Streams started within the block hold their states in RocksDB, which timers need; the session's own setting comes back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def rate_limited_stream(events: DataFrame, key: str, ts: str, tie: str, limit: int, window_ms: int, late: str = "0 seconds") -> DataFrame:
    """Streaming twin of :func:`rate_limited`: state is the allowed times of a key, until the watermark has passed the last one's window.

    So no key that still counts is ever lost, and the keys that are held are those of one window (and ``late``, by which events may come out of order). Events that are later
    than that are left out. Start it within :func:`rocks_states`.
    """
    timed = events.select(F.col(key).cast("string").alias("k"), F.col(ts).cast("timestamp").alias("at"), F.unix_millis(F.col(ts).cast("timestamp")).alias("ms"), F.col(tie).cast("long").alias("id"))
    return timed.withWatermark("at", late).groupBy("k").transformWithStateInPandas(_Limiter(limit, window_ms), "id long, allowed boolean", "append", "EventTime")


def tumbling_counts(events: DataFrame, ts: str, by: str, width: str, late: str | None = None) -> DataFrame:
    """Extension: counts by window of event time, for batches and streams (``late`` sets a watermark)."""
    timed = events.withWatermark(ts, late) if late and events.isStreaming else events
    return timed.groupBy(F.window(ts, width).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")


def sessions(events: DataFrame, ts: str, by: str, gap: str) -> DataFrame:
    """Extension: sessions that end after a silent ``gap``."""
    return events.groupBy(F.session_window(ts, gap).alias("w"), by).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
