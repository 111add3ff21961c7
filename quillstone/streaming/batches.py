"""Micro-batches that shrink when they fail, and streams that stop after the batch they are in."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery, StreamingQueryListener

#: Rows of a piece at first and at least.
SIZE, LEAST = 50_000, 1


class _Files:
    """Small texts in a folder that any of Spark's stores can hold."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm, self.conf, self.root = spark._jvm, spark._jsc.hadoopConfiguration(), root.rstrip("/")

    def _at(self, name: str):
        path = self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.conf), path

    def has(self, name: str) -> bool:
        fs, path = self._at(name)
        return fs.exists(path)

    def get(self, name: str) -> str | None:
        fs, path = self._at(name)
        if not fs.exists(path):
            return None
        with_ = fs.open(path)
        try:
            return bytes(with_.readAllBytes()).decode()
        finally:
            with_.close()

    def put(self, name: str, text: str) -> None:
        fs, path = self._at(name)
        out = fs.create(path, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()


def shrinking_batches(stream: DataFrame, write: Callable[[DataFrame, int, str], None], checkpoint: str, size: int = SIZE, least: int = LEAST) -> DataStreamWriter:
    """A writer of ``stream`` that hands each batch to ``write`` (rows, batch, piece) in pieces of about ``size`` rows.

    A piece that fails is split in two by its rows' hashes, each half is tried by itself, and the size that works is kept in the
    checkpoint for later batches; below ``least`` the failure is raised. Pieces that were written are noted in the checkpoint,
    so a batch that is run again after a stop or a failure writes only what is missing; the cut of a batch is
    noted before its first piece. ``write`` should replace what a piece of the same name wrote before.
    """

    def run(batch: DataFrame, number: int) -> None:
        files = _Files(batch.sparkSession, f"{checkpoint.rstrip('/')}/pieces")
        held = batch.persist()
        try:
            start = files.get(f"{number}/start")
            if start is None:
                now = int(files.get("size") or size)
                start = str(max(1, -(-held.count() // now)))
                files.put(f"{number}/start", start)
            key = F.xxhash64(*[F.col(f"`{c}`") for c in held.columns])
            todo = [(int(start), i) for i in reversed(range(int(start)))]
            while todo:
                parts, i = todo.pop()
                name = f"{parts}-{i}"
                if files.has(f"{number}/done/{name}"):
                    continue
                if not files.has(f"{number}/split/{name}"):
                    rows = held.where(F.pmod(key, F.lit(parts)) == i)
                    try:
                        write(rows, number, name)
                        files.put(f"{number}/done/{name}", "")
                        continue
                    except Exception:
                        n = rows.count()
                        if n <= least or n <= 1:
                            raise
                        files.put(f"{number}/split/{name}", "")
                        files.put("size", str(max(least, n // 2)))
                todo += [(2 * parts, i + parts), (2 * parts, i)]
        finally:
            held.unpersist()

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)


class StopAfterBatch(StreamingQueryListener):
    """Stops a query when the batch that it is in is done, once ``ask`` was called or a stop file is there.

    A query goes on from its checkpoint, so nothing is lost or repeated."""

    def __init__(self, spark: SparkSession, stop_file: str | None = None) -> None:
        self.spark, self.stop_file, self.asked, self.stopped = spark, stop_file, False, []

    def ask(self) -> None:
        self.asked = True

    def _wanted(self) -> bool:
        return self.asked or (self.stop_file is not None and _Files(self.spark, self.stop_file.rpartition("/")[0]).has(self.stop_file.rpartition("/")[2]))

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        if self._wanted():
            progress = json.loads(event.progress.json)
            query: StreamingQuery | None = self.spark.streams.get(progress["id"])
            if query is not None and query.isActive:
                self.stopped.append(progress["batchId"])
                query.stop()

    def onQueryTerminated(self, event) -> None:
        pass
