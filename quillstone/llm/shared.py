"""What several operators need: shared storage, exact text hashing in numpy, and runs of sorted keys."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillstone.functions.tables import shared_dir

WHITE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one numpy pass works on; bounds a Python worker's memory.
PASS_BYTES = 1 << 20


class Stage:
    """Tables written to the shared folder, to cut lineage; ``drop`` deletes one that is no longer read."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def broadcast_if_small(df: DataFrame, rows: int, most: int = 500_000) -> DataFrame:
    """A broadcast hint for a narrow table of ``rows`` counted rows, up to ``most``; beyond it Spark shuffles."""
    return F.broadcast(df) if rows <= most else df


def as_struct(docs: DataFrame, *more: Column) -> DataFrame:
    """The rows of ``docs`` as one column _d beside others, whose names can't clash with its own."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_d"), *more)


def from_struct(df: DataFrame, docs: DataFrame, new: dict[str, Column]) -> DataFrame:
    """The columns of ``docs`` out of _d, with some computed anew (in their own types)."""
    return df.select(*[new[c].cast(docs.schema[c].dataType).alias(c) if c in new else F.col("_d").getField(c).alias(c) for c in docs.columns])


def runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Frames of equal ``keys`` from sorted batches, of which none is in two frames; small runs come one by one."""
    rest: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        change = np.zeros(len(batch), dtype=bool)
        for k in keys:
            v = batch[k].to_numpy()
            change[1:] |= v[1:] != v[:-1]
        if rest and all(batch[k].iat[0] == rest[-1][k].iat[-1] for k in keys):
            cuts = np.flatnonzero(change)
            end = int(cuts[0]) if len(cuts) else len(batch)
            rest.append(batch.iloc[:end])
            if end == len(batch):
                continue
            batch, change = batch.iloc[end:], change[end:]
        if rest:
            yield pd.concat(rest, ignore_index=True) if len(rest) > 1 else rest[0]
            rest = []
        cuts = [0, *(np.flatnonzero(change[1:]) + 1).tolist(), len(batch)]
        for a, b in zip(cuts[:-2], cuts[1:-1], strict=True):
            yield batch.iloc[a:b]
        rest = [batch.iloc[cuts[-2] :]]
    if rest:
        yield pd.concat(rest, ignore_index=True) if len(rest) > 1 else rest[0]


def in_blocks(members: DataFrame, key: str, item: str, block: int) -> DataFrame:
    """Rows of a self-join on ``key``, cut so that no task holds a whole large group.

    A group of n items gets ceil(n / block) blocks, and each pair of blocks (p, q) is a run of its own; adds
    ``p``, ``q`` and ``part`` (the row's own block). Every pair of items meets in exactly one run. Groups of one
    item go. Rows of a group of up to ``block`` items aren't repeated.
    """
    n = members.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    dealt = members.join(n, key).withColumn("_b", F.ceil(F.col("_n") / block).cast("int"))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64(item, F.lit(17)), F.col("_b")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_b") - 1))
    dealt = dealt.select("*", other.alias("_o"))
    return dealt.withColumns({"p": F.least("part", "_o"), "q": F.greatest("part", "_o")}).drop("_n", "_b", "_o")


# ---------------------------------------------------------------- text in numpy


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def numbers(seed: int, n: int) -> np.ndarray:
    """n fixed odd 64-bit multipliers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


IS_WHITE = np.zeros(256, dtype=bool)
IS_WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: White space and ASCII punctuation.
BETWEEN = IS_WHITE.copy()
BETWEEN[[ord(c) for c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = np.uint64(0xD1342543DE82EF95)
_TABLE = numbers(7, 256)[LOWER]  # A-Z hash as a-z
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) <= n:
        size = max(n + 1, PASS_BYTES + 1)
        with np.errstate(over="ignore"):
            up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, _BASE)]), dtype=np.uint64)
            down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, np.uint64(pow(int(_BASE), -1, 1 << 64)))]), dtype=np.uint64)
        _POWERS[:] = [up, down]
    return _POWERS[0], _POWERS[1]


def passes(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of a string column, about PASS_BYTES a time; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    column = column.fill_null("").cast(pa.large_string())
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None and column.buffers()[2].size else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + PASS_BYTES, "right")) - 1)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def words(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = IS_WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words, and for each text the number of its first word (and one past the last)."""
    on = np.empty(len(data) + 1, dtype=bool)
    on[:-1] = ~between[data]
    on[-1] = False
    first = on[:-1].copy()
    first[1:] &= ~on[:-2]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    first[inner] = on[inner]
    last = on[:-1] & ~on[1:]
    last[inner - 1] = on[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def prefix_sums(data: np.ndarray) -> np.ndarray:
    up, _ = _powers(len(data))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_TABLE[data] * up[: len(data)], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span (case of A-Z aside), from its text's prefix sums."""
    _, down = _powers(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingles(wh: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's shingles in order, and bounds per text; a shorter text is one shingle, an empty one none."""
    q = numbers(11, width)
    n = np.diff(bounds)
    count = np.where(n >= width, n - width + 1, (n > 0).astype(n.dtype))
    out = np.concatenate([[0], np.cumsum(count)])
    doc = np.repeat(np.arange(len(n)), count)
    at = bounds[:-1][doc] + (np.arange(out[-1]) - out[:-1][doc])
    last = bounds[1:][doc]
    padded = np.concatenate([wh, np.zeros(width, np.uint64)])
    h = np.zeros(len(at), dtype=np.uint64)
    for j in range(width):
        h += np.where(at + j < last, padded[at + j], np.uint64(0)) * q[j]
    return mix(h + np.minimum(n[doc], width).astype(np.uint64)), out


def distinct(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct hashes, sorted, and bounds."""
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    keep = np.ones(len(h), dtype=bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[keep], np.searchsorted(doc[keep], np.arange(len(bounds)))


def arrow_map(df: DataFrame, f: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from f(batch)

    return df.mapInArrow(each, schema)
