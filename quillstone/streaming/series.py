"""Series as stream state that ends: timers by event time close a series that has been idle and take it out of the state."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillstone.streaming.flows import timed

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "user_id long, event_type string, points long, earliest double, latest double, delta double, closed boolean"
_STATE = "points long, first_at timestamp, earliest double, last_at timestamp, latest double"
_COLUMNS = ["user_id", "event_type", "points", "earliest", "latest", "delta", "closed"]


class SeriesProcessor(StatefulProcessor):
    """Points, earliest and latest value of a series; a timer stands at ``idle`` seconds after its latest point."""

    def __init__(self, idle: int) -> None:
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.series = handle.getValueState("series", _STATE)

    def _row(self, key: tuple, held: tuple, closed: bool) -> pd.DataFrame:
        n, _, a, _, b = held
        return pd.DataFrame([(*key, n, a, b, round(b - a, 4), closed)], columns=_COLUMNS)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new = (0, None, 0.0, None, 0.0)
        n, first, a, last, b = self.series.get() if self.series.exists() else new
        for frame in rows:
            frame = frame.sort_values("ts", kind="stable")
            for at, v in zip(frame["ts"], frame["value"], strict=True):
                if last is not None and at - pd.Timestamp(last) > pd.Timedelta(seconds=self.idle):  # idle before this batch's watermark tells so
                    yield self._row(key, (n, first, a, last, b), True)
                    n, first, a, last, b = new
                n += 1
                if first is None or at < first:
                    first, a = at, float(v)
                if last is None or at >= last:
                    last, b = at, float(v)
        held = (n, pd.Timestamp(first).to_pydatetime(), a, pd.Timestamp(last).to_pydatetime(), b)
        self.series.update(held)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        at = pd.Timestamp(last)
        at = at.tz_localize("UTC") if at.tzinfo is None else at
        self.handle.registerTimer(int(at.timestamp() * 1000) + self.idle * 1000)
        yield self._row(key, held, False)

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        held = self.series.get()
        self.series.clear()
        yield self._row(key, held, True)

    def close(self) -> None:
        pass


def ending_series(events: DataFrame, idle: str = "7 days", late: str = "1 day", ts: str = "ts") -> DataFrame:
    """After each batch the series it touched, and once more, as closed, each series without a point for ``idle`` of event time.

    A closed series has left the state; a point that comes later begins a new one. Points later than ``late`` behind the
    newest are dropped, as the watermark has passed them. Needs the RocksDB state store (``with_state_store``).
    """
    seconds = int(pd.Timedelta(idle).total_seconds())
    e = timed(events, ts).select("user_id", "event_type", F.col(ts).alias("ts"), "value").where("value is not null and ts is not null")
    keyed = e.withWatermark("ts", late).groupBy("user_id", "event_type")
    return keyed.transformWithStateInPandas(SeriesProcessor(seconds), OUT, "Append", "EventTime")


def with_state_store(spark: SparkSession) -> SparkSession:
    """Sets the state store that timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return spark
