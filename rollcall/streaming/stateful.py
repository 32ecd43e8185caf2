"""Streams with state that ends: settled files, and a publisher that speaks when the moment comes.

Both keep their state in RocksDB (see ready), so it may outgrow memory, and restart from their checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HOUR = 3_600_000


def ready(spark: SparkSession) -> None:
    """Sets the state store that these streams need; before they start."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def _millis(times: pd.Series) -> pd.Series:
    return times.astype("datetime64[ms]").astype("int64")


class _Settling(StatefulProcessor):
    """For each path its time and size at the last sighting, and the time for which it was told."""

    def __init__(self, keep_ms: int) -> None:
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "modified long, size long, done long", self.keep_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        modified, size, done = self.last.get() if self.last.exists() else (-1, -1, -1)
        for some in rows:
            some = some.sort_values("seen", kind="stable")
            told = []
            for at, n in zip(_millis(some["modified"]), some["size"].astype("int64")):
                if (at, n) == (modified, size) and done != at:
                    done = at
                    told.append((key[0], pd.Timestamp(at, unit="ms"), n))
                modified, size = at, n
            if told:
                yield pd.DataFrame(told, columns=["path", "modified", "size"])
        self.last.update((int(modified), int(size), int(done)))

    def close(self) -> None: ...


def settled(sightings: DataFrame, keep_ms: int = 24 * HOUR) -> DataFrame:
    """(path, modified, size) of files that may be read: sightings (path, modified, size, seen) come as a
    stream; a file is settled when two sightings in a row agree on time and size, and is told once for
    that path and time. What is known of a path ends when it has not been seen for keep_ms, so the state
    is as large as the folder and not as all files that it ever held; a path that comes back later is
    new. Sightings of a path within a micro-batch are put in order batch of rows by batch of rows."""
    return sightings.groupBy("path").transformWithStateInPandas(_Settling(keep_ms), "path string, modified timestamp, size long", "Append", "ProcessingTime")


#: How long an import counts as going on, and one that failed as failed.
IMPORTING_MS, FAILED_MS = 180_000, 24 * HOUR


class _Publishing(StatefulProcessor):
    """For each key the changes that wait for quiet, and what goes on and until when."""

    def __init__(self, quiet_ms: int, importing_ms: int, failed_ms: int) -> None:
        self.quiet_ms, self.spans = quiet_ms, {"import_started": importing_ms, "import_failed": failed_ms}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting", "changes long, due long")
        self.going = handle.getValueState("going", "what string, file string, until long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        changes, due = self.waiting.get() if self.waiting.exists() else (0, None)
        for some in rows:
            some = some.sort_values("at", kind="stable")
            changes += len(some)
            turns = some[some["signal"] != "changed"]
            if len(turns):
                self._turn(turns["signal"].iloc[-1], turns["file"].iloc[-1], now)
        if due is not None:
            self.handle.deleteTimer(due)
        self.waiting.update((int(changes), now + self.quiet_ms))
        self.handle.registerTimer(now + self.quiet_ms)
        return iter(())

    def _turn(self, signal: str, file: str | None, now: int) -> None:
        if self.going.exists():
            self.handle.deleteTimer(self.going.get()[2])
            self.going.clear()
        if span := self.spans.get(signal):
            self.going.update(("importing" if signal == "import_started" else "failed", file or "", now + span))
            self.handle.registerTimer(now + span)

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        changes, told = 0, False
        if self.going.exists() and self.going.get()[2] <= at:
            self.going.clear()
            told = True
        if self.waiting.exists() and self.waiting.get()[1] <= at:
            changes = self.waiting.get()[0]
            self.waiting.clear()
            told = True
        if told:
            what, file, _ = self.going.get() if self.going.exists() else ("idle", None, None)
            yield pd.DataFrame({"key": [key[0]], "moment": [pd.Timestamp(at, unit="ms")], "changes": [changes], "activity": [what], "file": [file or None]})

    def close(self) -> None: ...


def publications(signals: DataFrame, quiet_ms: int = 150, importing_ms: int = IMPORTING_MS, failed_ms: int = FAILED_MS) -> DataFrame:
    """(key, moment, changes, activity, file): when to build a key's document anew, and what it says goes on.

    signals (key, signal, file, at) come as a stream; signal is changed, import_started, import_ended or
    import_failed. Changes of a key are told together once none has come for quiet_ms. An import that
    does not end is told as idle after importing_ms, one that failed after failed_ms. All this goes by
    processing time and timers in the state, so it comes at its moment, whether more signals come or not.
    """
    return signals.groupBy("key").transformWithStateInPandas(_Publishing(quiet_ms, importing_ms, failed_ms), "key string, moment timestamp, changes long, activity string, file string", "Append", "ProcessingTime")
