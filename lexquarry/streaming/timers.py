"""Retention and wake-ups as streams with state by key: timers on event time, expiry, and decisions that feed back."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lexquarry.operators.stateful import Waker

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep_state_on_disk(spark: SparkSession) -> None:
    """Timers need the store that keeps state on disk; to be called before a query starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class Retention(StatefulProcessor):
    """A key's life begins with its first event, lasts ttl whatever follows, and is purged by a timer once the watermark is past.

    Only the open life is kept, its start and how many events it has; a later event begins the next one.
    """

    def __init__(self, ttl_ms: int):
        self.ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.life = handle.getValueState("life", "began long, n long")

    def _purged(self, key, began: int, n: int) -> pd.DataFrame:
        return pd.DataFrame({"user_id": [key[0]], "began_ms": [began], "expires_ms": [began + self.ttl], "n": [n]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        began, n = self.life.get() if self.life.exists() else (None, 0)
        first = began
        for at in sorted(at for batch in rows for at in batch["at_ms"].tolist()):
            if began is None or at >= began + self.ttl:
                if began is not None:
                    yield self._purged(key, began, n)
                began, n = at, 0
            n += 1
        if began != first:
            if first is not None:
                self.handle.deleteTimer(first + self.ttl)
            self.handle.registerTimer(began + self.ttl)
        self.life.update((began, n))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.life.exists():
            began, n = self.life.get()
            if began + self.ttl <= expiredTimerInfo.getExpiryTimeInMs():
                yield self._purged(key, began, n)
                self.life.clear()

    def close(self) -> None:
        pass


def purged_lives(stream: DataFrame, ttl_seconds: int, lateness: str = "1 hour") -> DataFrame:
    """user_id, began_ms, expires_ms, n of every life that ended, as soon as the watermark is past its end."""
    rows = stream.withWatermark("ts", lateness).select("user_id", "ts", F.unix_millis("ts").alias("at_ms"))
    return rows.groupBy("user_id").transformWithStateInPandas(Retention(ttl_seconds * 1000), "user_id long, began_ms long, expires_ms long, n long", "append", "eventTime")


class Wakes(StatefulProcessor):
    """One model's wake-ups: the decision on each request depends on those before, kept as four numbers."""

    def __init__(self, awake_s: int, takes_s: int, per_day: int):
        self.rules = (awake_s, takes_s, per_day)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("kept", "heard long, started long, day long, spent long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        waker = Waker(*self.rules, *(self.kept.get() if self.kept.exists() else (None, None, None, 0)))
        given = pd.concat(list(rows)).sort_values(["at", "event_id"])
        said = [waker.take(at, kind) for at, kind in zip(given["at"].tolist(), given["event_type"].tolist())]
        self.kept.update((waker.heard, waker.started, waker.day, waker.spent))
        out = pd.DataFrame({"model": key[0], "event_id": given["event_id"].tolist(), "state": said})
        yield out[out["state"].notna()]

    def close(self) -> None:
        pass


def wake_requests(stream: DataFrame, models: int, awake_s: int, takes_s: int, per_day: int) -> DataFrame:
    """model, event_id, state of every request, as the batch twin decides."""
    rows = stream.select((F.col("user_id") % models).alias("model"), "event_id", "event_type", F.unix_micros("ts").alias("at"))
    return rows.groupBy("model").transformWithStateInPandas(Wakes(awake_s, takes_s, per_day), "model long, event_id long, state string", "append", "none")
