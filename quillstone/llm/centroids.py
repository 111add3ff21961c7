"""Centroid clustering with heap-ordered bounds: only vectors whose gap has expired are compared with all centroids again."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.shared import Stage, arrow_map

CENTROIDS, ROUNDS, DIMENSIONS, SCALE = 16, 3, 64, 64
#: Components are held within it, so that squared distances fit a long.
MOST = 1 << 27
#: Vectors of a block, which has heaps of its own and is a row of the state.
BLOCK = 4096
#: Below it, sums of products are exact in doubles.
_EXACT = 1 << 20
#: Bounds are widened by this share, far more than rounding takes.
_SLACK = 1e-12


def whole_vectors(embedding: Column, dimensions: int = DIMENSIONS, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component as double, held within MOST; null if a component is null or not finite, or their number is another."""
    x = embedding.cast("array<double>")
    good = (F.size(x) == dimensions) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.when(good, F.transform(x, lambda v: F.floor(F.least(F.greatest(v * scale, F.lit(-float(MOST))), F.lit(float(MOST)))).cast("int")))


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of x to rows of c."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) <= _EXACT:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)
    x, c = x.astype(np.int64), c.astype(np.int64)
    return np.stack([((x - row) ** 2).sum(1) for row in c], axis=1)


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row (ties: the smaller number), and how much nearer it is for certain than any other."""
    d = squared(x, c)
    near, rows = d.argmin(1), np.arange(len(x))
    upper = np.sqrt(d[rows, near].astype(np.float64)) * (1 + _SLACK)
    if len(c) == 1:
        return near, np.full(len(x), np.inf)
    d[rows, near] = np.iinfo(np.int64).max
    return near, np.sqrt(d.min(1).astype(np.float64)) * (1 - _SLACK) - upper


class Block:
    """Vectors with their clusters, and a heap per cluster of (gap + the cluster's drift when it was measured, row)."""

    def __init__(self, x: np.ndarray, k: int) -> None:
        self.x, self.k = x, k
        self.cluster = np.zeros(len(x), dtype=np.int32)
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(k)]
        self.delta = np.zeros((k, x.shape[1] + 1), dtype=np.int64)
        self.popped = 0

    @classmethod
    def read(cls, vectors: bytes, cluster: bytes, keys: bytes, order: bytes, k: int, dimensions: int) -> Block:
        block = cls(np.frombuffer(vectors, dtype="<i4").reshape(-1, dimensions), k)
        block.cluster = np.frombuffer(cluster, dtype="<i4").copy()
        held, rows = np.frombuffer(keys, dtype="<f8"), np.frombuffer(order, dtype="<i4")
        ends = np.cumsum(np.bincount(block.cluster, minlength=k))
        for c in range(k):
            a = ends[c - 1] if c else 0
            block.heaps[c] = list(zip(held[a : ends[c]].tolist(), rows[a : ends[c]].tolist(), strict=True))
        return block

    def written(self) -> tuple[bytes, bytes, bytes, bytes]:
        """What ``read`` takes; the heaps in their order, one after the other."""
        entries = [e for heap in self.heaps for e in heap]
        keys, order = np.array([k for k, _ in entries], dtype="<f8"), np.array([r for _, r in entries], dtype="<i4")
        return self.x.astype("<i4").tobytes(), self.cluster.astype("<i4").tobytes(), keys.tobytes(), order.tobytes()

    def _count(self, rows: np.ndarray, clusters: np.ndarray, sign: int) -> None:
        np.add.at(self.delta[:, 0], clusters, sign)
        for c in np.unique(clusters):
            self.delta[c, 1:] += sign * self.x[rows[clusters == c]].sum(0, dtype=np.int64)

    def fill(self, centroids: np.ndarray) -> None:
        """The first round: every vector is compared, and a sorted list is a heap."""
        near, gap = nearest(self.x, centroids)
        self.cluster = near.astype(np.int32)
        for r in np.argsort(gap, kind="stable").tolist():
            self.heaps[near[r]].append((float(gap[r]), r))
        self._count(np.arange(len(self.x)), near, 1)
        self.popped = len(self.x)

    def settle(self, centroids: np.ndarray, drift: np.ndarray) -> None:
        """A later round: vectors whose gap the drift has used up are popped, compared exactly and pushed where they belong."""
        expired: list[int] = []
        for c, heap in enumerate(self.heaps):
            while heap and heap[0][0] <= drift[c]:
                expired.append(heappop(heap)[1])
        self.popped = len(expired)
        if not expired:
            return
        rows = np.array(expired)
        near, gap = nearest(self.x[rows], centroids)
        for r, c, g in zip(expired, near.tolist(), gap.tolist(), strict=True):
            heappush(self.heaps[c], (g + drift[c] - _SLACK * abs(drift[c]), r))
        old = self.cluster[rows]
        moved = old != near
        self._count(rows[moved], old[moved], -1)
        self._count(rows[moved], near[moved], 1)
        self.cluster[rows] = near


_STATE = ["vectors", "cluster", "keys", "order"]


def _state(ids: list[pa.Array], blocks: list[Block], kind: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*[b.written() for b in blocks], strict=True))
    held = [pa.array(list(c), pa.binary()) for c in columns]
    id_lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(i) for i in ids])]), pa.int32()), pa.concat_arrays(ids).cast(kind))
    delta, popped = pa.array([b.delta.ravel() for b in blocks], pa.list_(pa.int64())), pa.array([b.popped for b in blocks], pa.int64())
    return pa.RecordBatch.from_arrays([id_lists, *held, delta, popped], ["ids", *_STATE, "delta", "popped"])


def first_centroids(rows: DataFrame, k: int = CENTROIDS, seed: str = "1") -> list[list[int]]:
    """The k vectors with the smallest hex SHA-256 of ``seed:id`` (a null id is empty), in its order; ties by vector."""
    code = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_id").cast("string"), F.lit(""))).cast("binary"), 256)
    return [list(r._x) for r in rows.select(code.alias("_h"), "_x").orderBy("_h", "_x").limit(k).collect()]


def centroid_clusters(
    spark: SparkSession, vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, id_col: str = "vec_id", embedding_col: str = "embedding"
) -> tuple[DataFrame, list[list[int]], list[int]]:
    """(id, cluster, distance) of each kept vector, the final centroids, and how many vectors each round compared with all centroids.

    Vectors are whole numbers (``whole_vectors``) and sums, means and squared distances exact, so results don't depend on the
    partitions. ``rounds`` times every vector is assigned and centroids become floor(sum / count); then vectors are
    assigned once more. A vector's heap entry is its gap (a lower bound of the distance to any other centroid less an
    upper bound of that to its own) plus its cluster's drift so far: each round adds the cluster's own movement and the
    largest of another. While the drift is below the entry, no other centroid can be nearer, so nothing is looked at
    but the heaps' tops. Bounds are widened beyond rounding, and equal distances always expire.

    The state is a table of blocks, each with its heaps, written to the shared folder each round, without a shuffle; a
    round sums k x (dimensions + 1) numbers over the vectors that moved, and these and the centroids are all that the
    driver sees. Vectors that are null, of another length, or hold null or non-finite components have no row. Components
    beyond MOST count as MOST. Null ids and repeated rows are kept, each row for itself. With fewer than k vectors there are as many
    centroids as vectors; an empty table gives no rows. Other columns are ignored.
    """
    stage = Stage(spark, "centroids")
    rows = vectors.select(F.col(f"`{id_col}`").alias("_id"), whole_vectors(F.col(f"`{embedding_col}`"), dimensions, scale).alias("_x")).where("_x is not null")
    start = first_centroids(rows, k)
    kind = rows.schema["_id"].dataType.simpleString()
    out_schema = f"_id {kind}, cluster int, distance long"
    if not start:
        return spark.createDataFrame([], out_schema).withColumnRenamed("_id", id_col), [], [0] * (rounds + 1)
    k = len(start)
    schema = f"ids array<{kind}>, vectors binary, cluster binary, keys binary, order binary, delta array<bigint>, popped bigint"

    def filled(centroids: np.ndarray):
        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for a in range(0, batch.num_rows, BLOCK):
                part = batch.slice(a, BLOCK)
                block = Block(part.column("_x").flatten().to_numpy(zero_copy_only=False).astype(np.int32).reshape(-1, dimensions), k)
                block.fill(centroids)
                yield _state([part.column("_id")], [block], part.column("_id").type)

        return each

    def settled(centroids: np.ndarray, drift: np.ndarray):
        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for i in range(batch.num_rows):
                block = Block.read(*(batch.column(c)[i].as_buffer() for c in _STATE), k, dimensions)
                block.settle(centroids, drift)
                ids = batch.column("ids")[i].values
                yield _state([ids], [block], ids.type)

        return each

    def distances(centroids: np.ndarray):
        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for i in range(batch.num_rows):
                block = Block.read(*(batch.column(c)[i].as_buffer() for c in _STATE), k, dimensions)
                d = ((block.x.astype(np.int64) - centroids[block.cluster]) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays([batch.column("ids")[i].values, pa.array(block.cluster), pa.array(d)], ["_id", "cluster", "distance"])

        return each

    now = np.array(start, dtype=np.int64)
    state = stage.cut(arrow_map(rows, filled(now), schema), "round-0")
    sums, drift = np.zeros((k, dimensions + 1), dtype=object), np.zeros(k)
    compared = [state.agg(F.sum("popped")).first()[0]]
    for r in range(1, rounds + 1):
        for at, change in state.select(F.posexplode("delta").alias("at", "change")).groupBy("at").agg(F.sum("change")).collect():
            sums[at // (dimensions + 1), at % (dimensions + 1)] += change
        before, now = now, np.array([[int(s) // int(row[0]) for s in row[1:]] if row[0] else old.tolist() for row, old in zip(sums, now, strict=True)], dtype=np.int64)
        moves = np.sqrt(((now - before) ** 2).sum(1).astype(np.float64)) * (1 + _SLACK)
        others = np.array([np.delete(moves, c).max(initial=0.0) for c in range(k)])
        drift = (drift + moves + others) * (1 + _SLACK)
        state = stage.cut(arrow_map(state.select("ids", *_STATE), settled(now, drift), schema), f"round-{r}")
        stage.drop(f"round-{r - 1}")
        compared.append(state.agg(F.sum("popped")).first()[0])
    out = arrow_map(state.select("ids", *_STATE), distances(now), out_schema)
    return out.withColumnRenamed("_id", id_col), now.tolist(), compared


def clustered(spark: SparkSession, vectors: DataFrame) -> DataFrame:
    """Each vector's cluster, squared distance, the sums of distances of its cluster and of all (at most the largest long), and the hash of its centroid."""
    found, centroids, _ = centroid_clusters(spark, vectors)
    found = Stage(spark, "clustered").cut(found, "assigned")
    held = lambda x: F.least(x, F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("long")
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(19,0)")).cast("decimal(38,0)").alias("s"))
    hashes = [(c, hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for c, x in enumerate(centroids)]
    sums = sums.join(spark.createDataFrame(hashes, "cluster int, centroid_sha256 string"), "cluster")
    total = found.agg(F.sum(F.col("distance").cast("decimal(19,0)")).cast("decimal(38,0)").alias("t")).first().t
    sums = sums.select("cluster", held(F.col("s")).alias("cluster_inertia"), held(F.lit(total).cast("decimal(38,0)")).alias("inertia"), "centroid_sha256")
    return found.join(F.broadcast(sums), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # one row per centroid
