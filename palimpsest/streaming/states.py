"""Operators over streams that keep a state for each key, with timers of event time.

Events of a key may come in any order within the watermark: they wait until it has passed them, and are then taken in
the order of their times. What has been taken is forgotten but for the state that goes on.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _InOrder(StatefulProcessor):
    """Keeps a key's events until the watermark has passed them. Of events of one time the last in order of their
    values counts."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getMapState("pending", "at long", "flag boolean")
        self.since = handle.getValueState("since", "at long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        for some in rows:
            for at, flag in zip((some["ts"].astype("int64") // 1_000_000 if some["ts"].dtype == "datetime64[ns]" else some["ts"].astype("datetime64[ms]").astype("int64")).tolist(), some["flag"].tolist()):
                known = self.pending.containsKey((at,))
                if not known:
                    self.handle.registerTimer(at)
                self.pending.updateValue((at,), (bool(flag) or (known and bool(self.pending.getValue((at,))[0])),))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = expiredTimerInfo.getExpiryTimeInMs()
        # timers of one key may come in any order: all that is due is taken, once
        due = sorted((at, flag) for (at,), (flag,) in self.pending.iterator() if at <= until)
        out = []
        for at, flag in due:
            self.pending.removeKey((at,))
            out += self.step(key, at, bool(flag))
        yield pd.DataFrame(out, columns=["src", "dst", "introduced", "resolved"]) if out else pd.DataFrame()

    def close(self) -> None:
        pass


class _Violations(_InOrder):
    def step(self, key: tuple, at: int, broken: bool) -> list[tuple]:
        open_ = self.since.get()[0] if self.since.exists() else None
        if broken and open_ is None:
            self.since.update((at,))
        elif not broken and open_ is not None:
            self.since.clear()
            return [(*key, open_, at)]
        return []


def violations(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """(src, dst, introduced, resolved), in milliseconds, of a stream of events (src, dst, ts, flag) that tell whether an
    edge breaks a rule at a time: each violation once it is resolved and the watermark has passed its end. At one time
    a breach counts. State is what is still within the watermark and the beginning of what lasts."""
    use_store(events.sparkSession)
    rows = events.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), "ts", "flag").withWatermark("ts", late)
    return rows.groupBy("src", "dst").transformWithStateInPandas(_Violations(), "src string, dst string, introduced long, resolved long", "Append", "EventTime")


def use_store(spark: SparkSession) -> None:
    """State with timers needs the store that keeps it on disk; it has to be named before a query starts."""
    spark.conf.set(STORE, ROCKS)
