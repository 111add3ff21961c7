"""Vector operators: normalisation, exact blocked top-k, and a cell-pruned index."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.sources.sinks import write_vectors

#: Queries that go to every task at most; with more of them, blocks of so many queries meet blocks of ITEMS times as many items. Scores are
#: computed for TILE queries and ROWS items at once, and made anew for PAIRS, so a task's memory follows neither.
QUERY_BLOCK, ITEMS, TILE, ROWS, PAIRS = 20_000, 5, 512, 4_096, 16_384
_HITS = "query_id long, item_id long, score double"


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, v: s + v)


def l2_normalise(v: Column) -> Column:
    """v / |v| in doubles; a zero vector stays as it is."""
    size = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    return F.transform(v, lambda x: x.cast("double") / F.when(size == 0, 1.0).otherwise(size))


def exact_topk(
    spark: SparkSession, queries: DataFrame, items: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", block: int = QUERY_BLOCK
) -> DataFrame:
    """(query_id, item_id, score, rank): the k items of greatest inner product with each query (ties: smallest id).

    A stated query set against all items, whose ids are unique. At most ``block`` queries (counted) go to every task, which keeps k items
    per query of what it reads; more of them are hashed into blocks, as are the items, and every pair of blocks is one task's work.
    Only the k best of a task are shuffled.
    """
    q = queries.select(F.col(id_col).cast("long").alias("query_id"), F.col(vector_col).alias("v")).where("v is not null").dropDuplicates(["query_id"])
    rows = items.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where("id is not null and v is not null")
    return ranked(found_best(spark, q, rows, k, block), k)


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best (query_id, item_id, score) of each query, with their rank."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("item_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def found_best(spark: SparkSession, queries: DataFrame, items: DataFrame, k: int, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, item_id, score): the k best of each task. Where queries (query_id, v) have cells too (near), only items (id, v, cell) of those count."""
    n = queries.count()
    return _by_broadcast(spark, queries.toPandas(), items, k) if n <= block else _by_blocks(queries, items, k, -(-n // block), -(-items.count() // (ITEMS * block)))


def longest(x: np.ndarray) -> float:
    """The greatest length of the rows that are all numbers."""
    return float(np.sqrt((x * x).sum(axis=1)[np.isfinite(x).all(axis=1)].max(initial=0.0)))


def rough_of(q: float, x: float, dimensions: int) -> tuple[type, float]:
    """The precision for rough inner products of vectors whose greatest lengths are ``q`` and ``x``, and by how much one may be off: single, where
    lengths allow it, else double."""
    kind = np.float32 if all(1e-9 < n < 1e15 for n in (q, x)) else np.float64
    return kind, 2 * (dimensions + 4) * float(np.finfo(kind).eps) * q * x


def _none() -> pd.DataFrame:
    return pd.DataFrame({"query_id": [], "item_id": [], "score": []}).astype({"query_id": "int64", "item_id": "int64"})


def _below(bar: np.ndarray, kind: np.dtype) -> np.ndarray:
    return np.nextafter(bar.astype(kind), kind.type(-np.inf))


class _Tile:
    """The k best items so far of a few queries: (query's place, item, score), in order of queries and ranks. Scores that are no number are greatest, as Spark orders them."""

    def __init__(self, k: int, n: int) -> None:
        self.k, self.n, self.least = k, n, np.full(n, -np.inf)
        self.at, self.ids, self.scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def take(self, places: np.ndarray, ids: np.ndarray, rough: np.ndarray, off: float, q: np.ndarray, x: np.ndarray) -> None:
        """``rough`` has a row for each of the queries ``q`` at ``places`` and a column for each item of ``x``: their inner products, but for ``off`` at most.
        Those that may count are made anew, each of its pair alone, so equal vectors have equal scores."""
        near = ~(rough < _below(self.least[places] - off, rough.dtype)[:, None])
        if rough.shape[1] > 4 * self.k and np.count_nonzero(near) > 4 * self.k * len(places):
            near &= ~(rough < _below(np.partition(rough, -self.k, axis=1)[:, -self.k] - 2 * off, rough.dtype)[:, None])
        i, j = np.divmod(np.flatnonzero(near), rough.shape[1])
        if not len(i):
            return
        exact = [np.einsum("nd,nd->n", q[i[a : a + PAIRS]], x[j[a : a + PAIRS]]) for a in range(0, len(i), PAIRS)]
        at, item, score = np.concatenate([self.at, places[i]]), np.concatenate([self.ids, ids[j]]), np.concatenate([self.scores, *exact])
        key = np.where(np.isnan(score), np.inf, score)
        order = np.lexsort((item, -key, at))
        at, item, score, key = at[order], item[order], score[order], key[order]
        first = np.searchsorted(at, np.arange(self.n))
        nth = np.arange(len(at)) - first[at]
        full = nth == self.k - 1
        self.least[at[full]] = key[full]
        kept = nth < self.k
        self.at, self.ids, self.scores = at[kept], item[kept], score[kept]


class _Best:
    """The k best items so far of each of some queries, in tiles of TILE queries."""

    def __init__(self, queries: pd.DataFrame, k: int) -> None:
        self.ids = queries["query_id"].to_numpy()
        self.q = np.array(queries["v"].tolist(), dtype=np.float64) if len(queries) else np.zeros((0, 0))
        self.size = longest(self.q)
        self.single = self.q.astype(np.float32)
        self.tiles = [_Tile(k, min(TILE, len(self.ids) - a)) for a in range(0, len(self.ids), TILE)]
        self.near = None
        if "near" in queries:
            near = queries["near"].tolist()
            self.near = np.zeros((len(near), 1 + max((max(x) for x in near if len(x)), default=0)), dtype=bool)
            for i, cells in enumerate(near):
                self.near[i, cells] = True

    def take(self, items: pd.DataFrame) -> None:
        if not len(self.ids):
            return
        items = items[items["v"].map(lambda v: v is not None and len(v) == self.q.shape[1])]
        parts = [(None, items)] if self.near is None else items.groupby("cell")
        for cell, own in parts:
            for a in range(0, len(own), ROWS):
                part = own.iloc[a : a + ROWS]
                self._meet(np.array(part["v"].tolist(), dtype=np.float64), part["id"].to_numpy(), cell)

    def _meet(self, x: np.ndarray, ids: np.ndarray, cell: int | None) -> None:
        kind, off = rough_of(self.size, longest(x), x.shape[1])
        q, there = (self.single, x.astype(np.float32)) if kind is np.float32 else (self.q, x)
        for n, tile in enumerate(self.tiles):
            a = n * TILE
            places = np.arange(tile.n)
            if cell is not None:
                places = np.flatnonzero(self.near[a : a + TILE, cell]) if cell < self.near.shape[1] else places[:0]
            if len(places):
                tile.take(places, ids, q[a + places] @ there.T, off, self.q[a + places], x)

    def frames(self) -> Iterator[pd.DataFrame]:
        for n, t in enumerate(self.tiles):
            yield pd.DataFrame({"query_id": self.ids[n * TILE + t.at], "item_id": t.ids, "score": t.scores})


def _by_broadcast(spark: SparkSession, queries: pd.DataFrame, items: DataFrame, k: int) -> DataFrame:
    held = spark.sparkContext.broadcast(queries)

    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = _Best(held.value, k)
        for batch in batches:
            best.take(batch)
        yield _none()
        yield from best.frames()

    return items.mapInPandas(f, _HITS)


def _by_blocks(queries: DataFrame, items: DataFrame, k: int, n_queries: int, n_items: int) -> DataFrame:
    """As above, for queries that are too many for every task: each pair of a query block and an item block is a group of both."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(max(n, 1) - 1)))
    block = lambda name, n: F.pmod(F.xxhash64(name), F.lit(max(n, 1))).cast("int")
    left = queries.withColumn("p", block("query_id", n_queries)).withColumn("i", every(n_items))
    right = items.withColumn("i", block("id", n_items)).withColumn("p", every(n_queries))

    def f(own: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        best = _Best(own, k)
        best.take(others)
        return pd.concat([_none(), *best.frames()])

    return left.groupBy("p", "i").cogroup(right.groupBy("p", "i")).applyInPandas(f, _HITS)


class CellIndex:
    """Vectors in the cells of k-means centroids; a search looks into the nearest ``nprobe`` cells of each query.

    The centroids are fitted on at most ``sample`` vectors (a bounded, hashed sample); every vector is indexed.
    """

    def __init__(self, spark: SparkSession, centroids: np.ndarray, cells: DataFrame | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> None:
        self.spark, self.centroids, self.cells, self.id_col, self.vector_col, self.stored = spark, centroids, cells, id_col, vector_col, False

    @classmethod
    def fit(
        cls, spark: SparkSession, items: DataFrame, cells: int = 64, sample: int = 50_000, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 1
    ) -> CellIndex:
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        rows = items.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id is not null and v is not null")
        few = rows.orderBy(F.xxhash64("id"), "id").limit(sample).select(array_to_vector("v").alias("features"))
        index = cls(spark, np.array(KMeans(k=cells, seed=seed, maxIter=10).fit(few).clusterCenters()), id_col=id_col, vector_col=vector_col)
        index.cells = index._assigned(rows, 1).select("id", "v", F.col("near")[0].alias("cell"))
        return index

    def save(self, path: str) -> None:
        """Writes the centroids, and the vectors by cell."""
        centroids = [(i, c.tolist()) for i, c in enumerate(self.centroids)]
        self.spark.createDataFrame(centroids, "cell int, v array<double>").write.mode("overwrite").parquet(f"{path}/centroids")
        write_vectors(self.cells, f"{path}/cells")

    @classmethod
    def load(cls, spark: SparkSession, path: str, id_col: str = "vec_id", vector_col: str = "embedding") -> CellIndex:
        """A saved index: nothing is fitted or assigned again, and a search reads only the cells that it probes."""
        centroids = spark.read.parquet(f"{path}/centroids").orderBy("cell").toPandas()  # one row a cell
        index = cls(spark, np.array(centroids["v"].tolist(), dtype=np.float64), spark.read.parquet(f"{path}/cells"), id_col, vector_col)
        index.stored = True
        return index

    def _assigned(self, rows: DataFrame, n: int) -> DataFrame:
        held = self.spark.sparkContext.broadcast(self.centroids)

        def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            c = held.value
            for batch in batches:
                if len(batch):
                    x = np.array(batch["v"].tolist(), dtype=np.float64)
                    near = np.argsort(-(x @ c.T) + 0.5 * (c * c).sum(axis=1), axis=1, kind="stable")[:, :n]
                    yield batch.assign(near=near.tolist())

        return rows.mapInPandas(f, rows.schema.simpleString()[7:-1].replace(":", " ") + ", near array<int>")

    def search(self, queries: DataFrame, k: int, nprobe: int = 8, block: int = QUERY_BLOCK) -> DataFrame:
        """(query_id, item_id, score, rank) as ``exact_topk`` gives them, of the items in the cells probed: only the k best of a task are shuffled."""
        q = queries.select(F.col(self.id_col).cast("long").alias("query_id"), F.col(self.vector_col).cast("array<double>").alias("v")).where("v is not null")
        q = self._assigned(q.dropDuplicates(["query_id"]), nprobe)
        cells = self.cells
        if self.stored:
            cells = cells.where(F.col("cell").isin([r.cell for r in q.select(F.explode("near").alias("cell")).distinct().collect()]))  # as many as there are cells at most
        return ranked(found_best(self.spark, q, cells.select("id", "v", "cell"), k, block), k)
