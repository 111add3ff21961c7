"""Streams: incremental ingest, windows over late events, and a trend kept per series as state."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def file_stream(spark: SparkSession, path: str, schema: StructType, files: int = 100) -> DataFrame:
    """New Parquet files below a path; which were read is in the query's checkpoint."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def timed(events: DataFrame, ts: str = "ts") -> DataFrame:
    return events.withColumn(ts, F.col(ts).cast("timestamp"))


def tumbling(events: DataFrame, size: str = "1 day", late: str = "1 day", ts: str = "ts", value: str = "value", by: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Counts and sums of windows; works alike on a table and on a stream (with a watermark of ``late``)."""
    e = timed(events, ts)
    e = e.withWatermark(ts, late) if e.isStreaming else e
    return e.groupBy(F.window(ts, size), *by).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 2).alias("total")).select(F.col("window.start").alias("start"), *by, "n", "total")


def sliding(events: DataFrame, size: str = "2 days", step: str = "1 day", late: str = "1 day", ts: str = "ts", by: tuple[str, ...] = ("event_type",)) -> DataFrame:
    e = timed(events, ts)
    e = e.withWatermark(ts, late) if e.isStreaming else e
    return e.groupBy(F.window(ts, size, step), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), *by, "n")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 day", ts: str = "ts", by: tuple[str, ...] = ("user_id",)) -> DataFrame:
    e = timed(events, ts)
    e = e.withWatermark(ts, late) if e.isStreaming else e
    return e.groupBy(F.session_window(ts, gap), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *by, "n")


def first_seen(events: DataFrame, keys: list[str], late: str = "1 day", ts: str = "ts") -> DataFrame:
    """Each key once; on a stream within the watermark."""
    e = timed(events, ts)
    return e.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys) if e.isStreaming else e.dropDuplicates(keys)


_OUT = "user_id long, event_type string, points long, earliest double, latest double, delta double"
_STATE = "points long, first_at timestamp, earliest double, last_at timestamp, latest double"


def running_trend(events: DataFrame, ts: str = "ts") -> DataFrame:
    """After each batch, the series it touched: number of points, earliest and latest value, their difference. State is five
    numbers a series, however long it runs; late points are placed by their time."""

    def f(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, a_at, a, b_at, b = state.get if state.exists else (0, None, 0.0, None, 0.0)
        for frame in frames:
            for at, v in zip(frame["ts"], frame["value"], strict=True):
                n += 1
                if a_at is None or at < a_at:
                    a_at, a = at, float(v)
                if b_at is None or at >= b_at:
                    b_at, b = at, float(v)
        state.update((n, a_at, a, b_at, b))
        yield pd.DataFrame([(*key, n, a, b, round(b - a, 4))], columns=["user_id", "event_type", "points", "earliest", "latest", "delta"])

    e = timed(events, ts).select("user_id", "event_type", F.col(ts).alias("ts"), "value").where("value is not null and ts is not null")
    return e.groupBy("user_id", "event_type").applyInPandasWithState(f, _OUT, _STATE, "update", GroupStateTimeout.NoTimeout)


def to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataStreamWriter:
    """Everything there is now, then stop; a run after it goes on from the checkpoint."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True)
