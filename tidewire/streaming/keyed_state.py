"""State by key that expires: the breaker of hosts, and the titles of the last hours, on transformWithState.

Each key's state is one row in RocksDB, and a timer of event time clears it once the watermark has passed its time, so what
is held is bounded by the keys of the last hours and not by all that was ever seen. The session of the stream must have the
RocksDB provider (`session_with_state`). A key's rows of one trigger are taken in the order of time and id; only those two and
a response's status are held for that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewire.streaming.jobs import breaker_step

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def session_with_state(spark: SparkSession) -> SparkSession:
    """A session of its own with the settings of spark and state in RocksDB; the caller's keeps its own."""
    own = spark.newSession()
    for key, value in (spark.conf.getAll | {"spark.sql.streaming.stateStore.providerClass": PROVIDER}).items():
        if spark.conf.isModifiable(key):
            own.conf.set(key, value)
    return own


class _Expiring(StatefulProcessor):
    """One row of state, gone `seconds` after the last time it was set for."""

    def __init__(self, form: str, seconds: float):
        self.form, self.seconds = form, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("held", self.form)

    def hold(self, row: tuple, at: float, known: bool = True) -> None:
        """known: whether the key has state, and so a timer, already; each question to the state is a message of its own."""
        self.state.update(row)
        if known:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
        self.handle.registerTimer(int((at + self.seconds) * 1000) + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter([])

    def close(self) -> None:
        pass


class _Breaker(_Expiring):
    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        failures, until, last = self.state.get() if self.state.exists() else (0, 0.0, -np.inf)
        out = []
        for row in pd.concat(list(rows)).sort_values(["at", "id"]).itertuples():
            if row.at - last > self.seconds:  # as if the state had gone already: the watermark may lag behind
                failures, until = 0, 0.0
            failures, until = breaker_step(failures, until, row.at, row.status, None if pd.isna(row.retry_after) else row.retry_after)
            last = row.at
            out.append((key[0], row.id, failures, until))
        self.hold((int(failures), float(until), float(last)), last)
        yield pd.DataFrame(out, columns=["host", "id", "failures", "blocked_until"])


def breaker(fetches: DataFrame, forget: float = 86_400.0, late: str = "10 minutes") -> DataFrame:
    """host, id, failures, blocked_until after each response (host, id, at in seconds, status, retry_after); a host that is not heard of for `forget` seconds starts anew."""
    rows = fetches.withColumn("seen", F.timestamp_seconds("at")).withWatermark("seen", late)
    form = "host string, id long, failures long, blocked_until double"
    return rows.groupBy("host").transformWithStateInPandas(_Breaker("failures long, blocked_until double, last double", forget), form, "append", "EventTime")


class _Titles(_Expiring):
    """On plain rows: most titles have one or two, and a table for each costs more than what is done with it."""

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = held = self.state.get()
        for created_at, rowid in sorted((row.created_at, row.rowid) for row in rows):
            new = held is None or created_at - held[1] > self.seconds
            yield Row(title_hash=key[0], rowid=rowid, created_at=created_at, status="new" if new else "dupe", match=None if new else held[0])
            if new:
                held = (rowid, created_at)
        if before is None or held[0] != before[0]:  # else state and timer are as they were
            self.hold(held, held[1], before is not None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.state.clear()
        return iter([])


def first_titles(items: DataFrame, hours: float = 72, late: str = "1 hour") -> DataFrame:
    """title_hash, rowid, created_at, status, match of a stream of items (rowid, title_hash, created_at in seconds): the first of a title hides the others for `hours`, then the next one is new. A title's state is gone when its hours are."""
    rows = items.select("title_hash", "rowid", "created_at", F.timestamp_seconds("created_at").alias("seen")).withWatermark("seen", late)
    form = "title_hash string, rowid long, created_at double, status string, match long"
    return rows.groupBy("title_hash").transformWithState(_Titles("rowid long, created_at double", 3600 * hours), form, "append", "EventTime")
