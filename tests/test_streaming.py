"""State that ends, batches that shrink, and streams that stop between batches."""

import datetime as dt
import time

import pytest

from quillstone.streaming.batches import StopAfterBatch, shrinking_batches
from quillstone.streaming.flows import file_stream
from quillstone.streaming.series import ending_series, with_state_store

SCHEMA = "user_id long, event_type string, ts timestamp, value double"


def at(day, hour=0):
    return dt.datetime(2026, 1, 1) + dt.timedelta(days=day, hours=hour)




def test_idle_series_leave_the_state(spark, tmp_path):
    with_state_store(spark)
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = spark.createDataFrame([], SCHEMA).schema
    steps = [
        [(1, "a", at(0), 5.0), (1, "a", at(1), 7.0), (2, "a", at(1), 1.0)],
        [(1, "a", at(0, 12), 6.0), (2, "a", at(4), 2.0)],  # a late point is placed by its time
        [(2, "a", at(20), 9.0)],  # user 1 is idle for long
        [(2, "a", at(21), 8.0), (1, "a", at(2), 99.0)],  # behind the watermark: dropped
        [(1, "a", at(30), 4.0)],  # a new series of user 1; user 2 is not yet idle
    ]
    try:
        for rows in steps:
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(src)
            stream = ending_series(file_stream(spark, src, schema), idle="7 days", late="1 day")
            stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(180)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    rows = [tuple(r) for r in spark.read.parquet(out).collect()]
    closed = sorted(r for r in rows if r[6])
    assert (1, "a", 3, 5.0, 7.0, 2.0, True) in closed
    assert (1, "a", 1, 4.0, 4.0, 0.0, False) in rows  # the state began anew
    assert not any(99.0 in r for r in rows)
    assert (2, "a", 2, 1.0, 2.0, 1.0, True) in closed  # idle from day 4 to day 20


def test_failing_batches_shrink_and_nothing_is_lost(spark, tmp_path):
    src, check = str(tmp_path / "in"), str(tmp_path / "c")
    spark.range(1000).selectExpr("id", "id % 7 as k").coalesce(1).write.parquet(src)
    schema = spark.read.parquet(src).schema
    sizes, most = [], [300]

    def write(rows, batch, piece):
        n = rows.count()
        sizes.append(n)
        if n > most[0]:
            raise MemoryError(f"{n} rows are too many")
        rows.write.mode("overwrite").parquet(str(tmp_path / f"out/{batch}/{piece}"))

    run = lambda: shrinking_batches(file_stream(spark, src, schema), write, check, size=800).trigger(availableNow=True).start().awaitTermination(120)
    run()
    read = lambda: sorted(r.id for r in spark.read.option("recursiveFileLookup", True).parquet(str(tmp_path / "out")).collect())
    assert read() == list(range(1000)) and max(sizes) > 300
    sizes.clear()
    spark.range(1000, 1500).selectExpr("id", "id % 7 as k").coalesce(1).write.mode("append").parquet(src)
    run()
    assert read() == list(range(1500)) and max(sizes) <= 300  # the size that worked was kept


def test_a_stopped_batch_goes_on_where_it_was(spark, tmp_path):
    src, check = str(tmp_path / "in"), str(tmp_path / "c")
    spark.range(400).selectExpr("id", "id % 7 as k").coalesce(1).write.parquet(src)
    schema = spark.read.parquet(src).schema
    seen, broken = [], [True]

    def write(rows, batch, piece):
        if broken[0] and len(seen) == 2:
            raise RuntimeError("the executor is gone")
        seen.append((batch, piece))
        rows.write.mode("append").parquet(str(tmp_path / "out"))  # would repeat rows, were a piece written twice

    start = lambda: shrinking_batches(file_stream(spark, src, schema), write, check, size=100, least=200).trigger(availableNow=True).start()
    with pytest.raises(Exception):  # noqa: B017
        start().awaitTermination(120)
    broken[0] = False
    start().awaitTermination(120)
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(400)) and len(set(seen)) == len(seen) == 4


def test_stop_after_batch(spark, tmp_path):
    src, check, out = str(tmp_path / "in"), str(tmp_path / "c"), str(tmp_path / "out")
    for i in range(6):
        spark.range(i * 10, i * 10 + 10).coalesce(1).write.mode("append").parquet(src)
    schema = spark.read.parquet(src).schema
    listener = StopAfterBatch(spark, str(tmp_path / "stop"))
    spark.streams.addListener(listener)
    begin = lambda: file_stream(spark, src, schema, files=1).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(processingTime="1 second").start()
    try:
        listener.ask()
        query = begin()
        query.awaitTermination(90)
        assert not query.isActive and listener.stopped
        first = spark.read.parquet(out).count()
        assert 0 < first < 60 and first % 10 == 0
        listener.asked = False
        query = begin()
        for _ in range(90):
            time.sleep(1)
            if spark.read.parquet(out).count() == 60:
                break
        (tmp_path / "stop").write_text("")
        query.awaitTermination(30)
        query.stop()
    finally:
        spark.streams.removeListener(listener)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(60))
