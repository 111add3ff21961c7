"""A kept vector index with product codes: cells, residuals in packed codes, slabs that are appended and committed, exact re-ranking."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.functions.expressions import let
from quillstone.functions.tables import written
from quillstone.operators.vectors import longest, ranked, rough_of

#: Subspaces of a vector (a byte each), codes of a subspace, vectors that cells and codes are fitted on at most, rounds of fitting.
PARTS, CODES, SAMPLE, ROUNDS = 16, 256, 50_000, 12
#: Queries that are searched for at once at most, codes of a cell that they meet in one task, codes of which candidates are taken, queries whose
#: scores are computed at once.
QUERY_BLOCK, CODE_BLOCK, PART, TILE = 40_000, 20_000, 4_096, 256


def fitted(x: np.ndarray, k: int, seed: int, rounds: int = ROUNDS) -> np.ndarray:
    """k-means centroids of a bounded sample (fewer, if there are fewer different rows)."""
    different = np.unique(x, axis=0)
    rng = np.random.default_rng(seed)
    c = different[np.sort(rng.choice(len(different), min(k, len(different)), replace=False))]
    for _ in range(rounds):
        near = nearest(x, c)
        n = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half, out = 0.5 * (c * c).sum(1), np.empty(len(x), dtype=np.int64)
    for a in range(0, len(x), 4096):
        out[a : a + 4096] = (half - x[a : a + 4096] @ c.T).argmin(1)
    return out


@dataclass(frozen=True)
class Quantiser:
    """Centroids of the cells, for each subspace the centroids of residuals, and by what each cell's residuals are divided for that: their
    usual length, so that codes tell vectors of a tight cell apart too."""

    cells: np.ndarray
    books: list[np.ndarray]
    scale: np.ndarray

    @property
    def dimensions(self) -> int:
        return self.cells.shape[1]

    def cut(self, x: np.ndarray) -> list[np.ndarray]:
        return np.array_split(x, len(self.books), axis=1)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each vector, and the codes of what its centroid leaves of it."""
        cell = nearest(x, self.cells)
        return cell, np.stack([nearest(r, b) for r, b in zip(self.cut((x - self.cells[cell]) / self.scale[cell, None]), self.books, strict=True)], axis=1).astype(np.uint8)

    def decoded(self, codes: np.ndarray) -> np.ndarray:
        """What the codes (rows, parts) say of scaled residuals, in single precision."""
        return np.concatenate([book[codes[:, i]] for i, book in enumerate(self.books)], axis=1).astype(np.float32)


class ProductIndex:
    """A folder of an index: ``quantiser`` (fitted once), ``codes`` in slabs, each with its vector, and a ``manifest`` of the slabs that are whole.

    Readers see the slabs of the manifest and nothing else; a slab is entered there after all its files are written. To append
    a slab that is there does nothing; one that was begun and not entered is written anew.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    # ------------------------------------------------------------ build

    @classmethod
    def fit(
        cls, spark: SparkSession, vectors: DataFrame, path: str, cells: int = 256, parts: int = PARTS, sample: int = SAMPLE, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 1
    ) -> ProductIndex:
        """A new, empty index at ``path``: cells and codes are fitted on at most ``sample`` vectors (hashed, so the same ones each time).
        Each subspace's codes are fitted in a task of its own. Vectors of another length than most have are no part of it."""
        index = cls(spark, path)
        rows = _clean(vectors, id_col, vector_col)
        length = rows.groupBy(F.size("v").alias("s")).count().orderBy(F.desc("count"), "s").first()
        rows = rows.where(F.size("v") == (length.s if length else 0))
        few = rows.orderBy(F.xxhash64("id"), "id").limit(sample).toPandas()
        x = np.array(few["v"].tolist(), dtype=np.float64)
        if not len(x):
            raise ValueError("an index needs vectors to be fitted on")
        centers = fitted(x, cells, seed)
        near = nearest(x, centers)
        rest = x - centers[near]
        scale = np.sqrt(np.bincount(near, (rest**2).sum(1), len(centers)) / np.maximum(np.bincount(near, minlength=len(centers)), 1))
        scale = np.where(scale > 1e-9, scale, 1.0)
        rest /= scale[near, None]
        cuts = [(i, part.ravel().tolist(), part.shape[1]) for i, part in enumerate(np.array_split(rest, parts, axis=1))]

        def book(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for i, flat, width in zip(batch["part"], batch["flat"], batch["width"], strict=True):
                    c = fitted(np.array(flat, dtype=np.float64).reshape(-1, int(width)), CODES, seed + 1 + int(i))
                    yield pd.DataFrame({"part": [i], "width": [c.shape[1]], "flat": [c.ravel().tolist()]})

        books = spark.createDataFrame(cuts, "part int, flat array<double>, width int").repartition(parts, "part").mapInPandas(book, "part int, width int, flat array<double>")
        whole = [(-1, centers.shape[1], centers.ravel().tolist()), (-2, 1, scale.tolist())]
        books.unionByName(spark.createDataFrame(whole, "part int, width int, flat array<double>").coalesce(1)).write.mode("overwrite").parquet(f"{index.path}/quantiser")
        return index

    def quantiser(self) -> Quantiser:
        rows = {r.part: np.array(r.flat).reshape(-1, r.width) for r in self.spark.read.parquet(f"{self.path}/quantiser").collect()}  # a row a subspace
        cells, scale = rows.pop(-1), rows.pop(-2).ravel()
        return Quantiser(cells, [rows[i] for i in sorted(rows)], scale)

    def slabs(self) -> set[str]:
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        fs = fs_path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(fs_path):
            return set()
        return {s.getPath().getName() for s in fs.listStatus(fs_path) if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))}

    def append(self, slab: str, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> bool:
        """Adds the vectors as slab ``slab`` (letters, digits, - and _); False if it is there. Only new vectors are assigned. Null
        ids, and vectors that are null, of another length or hold nulls or non-finite components, are left out. Of several
        vectors of an id the first in order counts; an id belongs to one slab."""
        if not slab.replace("-", "").replace("_", "").isalnum():
            raise ValueError("a slab's name is of letters, digits, - and _")
        if slab in self.slabs():
            return False
        held = self.spark.sparkContext.broadcast(self.quantiser())

        def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                    cell, codes = held.value.encode(x)
                    code = pa.array([c.tobytes() for c in codes], pa.binary())
                    yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(cell, pa.int32()), code, batch.column("v")], ["id", "cell", "code", "v"])

        rows = _clean(vectors, id_col, vector_col).where(F.size("v") == held.value.dimensions)
        rows = rows.groupBy("id").agg(F.min("v").alias("v"))
        rows.mapInArrow(f, _CODES).hint("rebalance", "cell").sortWithinPartitions("cell").write.mode("overwrite").parquet(f"{self.path}/codes/{slab}")
        n = self.spark.read.parquet(f"{self.path}/codes/{slab}").count()
        self.spark.createDataFrame([(slab, n)], "slab string, vectors long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/{slab}")
        return True

    def codes(self) -> DataFrame:
        found = sorted(self.slabs())
        return self.spark.read.parquet(*[f"{self.path}/codes/{x}" for x in found]) if found else self.spark.createDataFrame([], _CODES)

    # ------------------------------------------------------------ search

    def search(self, queries: DataFrame, k: int, nprobe: int = 8, again: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", block: int = QUERY_BLOCK) -> DataFrame:
        """(query_id, item_id, score, rank, scanned): the k items of greatest inner product with each query among those in the ``nprobe`` cells
        nearest to it that are of the ``again * k`` best by codes of their cell's part; ``scanned`` codes were looked at for it. Scores are exact.

        Candidates are taken of each part of at most PART codes of a cell and scored where they are found, so recall doesn't fall as the
        index grows and only the k best of a task are shuffled. Queries of any number are hashed into blocks of about ``block``, cells into
        blocks of about CODE_BLOCK; the queries of a block that probe a cell meet each of its blocks in a task."""
        quantiser = self.quantiser()
        held = self.spark.sparkContext.broadcast(quantiser)
        few = _clean(queries, id_col, vector_col).where(F.size("v") == quantiser.dimensions).dropDuplicates(["id"])

        def nearest_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cells = held.value.cells
            for batch in batches:
                if batch.num_rows:
                    x = _matrix(batch.column("v"), batch.num_rows)
                    near = np.argsort(0.5 * (cells**2).sum(1) - x @ cells.T, axis=1, kind="stable")[:, :nprobe].astype(np.int32)
                    yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(list(near), pa.list_(pa.int32()))], ["id", "v", "near"])

        probing = written(few.mapInArrow(nearest_cells, "id long, v array<double>, near array<int>"), "probing")
        n_queries = max(1, -(-probing.count() // block))
        codes = self.codes()
        sizes = [(r.cell, -(-r["count"] // CODE_BLOCK)) for r in codes.groupBy("cell").count().collect()]  # as many as there are cells at most
        parts = F.broadcast(self.spark.createDataFrame(sizes, "cell int, parts int"))
        dealt = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        left = probing.select("id", "v", F.explode("near").alias("cell")).join(parts, "cell").select("id", "v", "cell", dealt(F.lit(n_queries)).alias("p"), every(F.col("parts")).alias("i"))
        right = codes.join(parts, "cell").select("id", "code", "v", "cell", dealt(F.col("parts")).alias("i"), every(F.lit(n_queries)).alias("p"))
        most = again * k

        def f(own: pa.Table, others: pa.Table) -> pa.Table:
            return _scanned(held.value, own, others, most, k)

        found = left.groupBy("cell", "i", "p").cogroup(right.groupBy("cell", "i", "p")).applyInArrow(f, "query_id long, item_id long, score double, seen long")
        found = found.withColumn("scanned", F.sum("seen").over(Window.partitionBy("query_id"))).select("query_id", "item_id", "score", "scanned")
        return ranked(found, k)


_CODES = "id long, cell int, code binary, v array<double>"


def _matrix(column: pa.Array | pa.ChunkedArray, n: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def _scanned(quantiser: Quantiser, own: pa.Table, others: pa.Table, most: int, k: int) -> pa.Table:
    """(query_id, item_id, score, seen): the k best of a cell's items for each query, of the ``most`` best by codes of each PART of them, and how many were looked at (in its first row)."""
    n, out = others.num_rows, [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))]
    if n and own.num_rows:
        asked, q = own["id"].to_numpy(), _matrix(own["v"], own.num_rows)
        item, x = others["id"].to_numpy(), _matrix(others["v"], n)
        by_id = np.argsort(item)
        about = None
        if n > 4 * most:  # fewer are all scored at once, which takes no longer
            code = np.frombuffer(b"".join(others["code"].to_pylist()), dtype=np.uint8).reshape(n, -1)
            by_id = by_id[_first_of_codes(code[by_id], most)]
            about = quantiser.decoded(code[by_id])
        item, x = item[by_id], x[by_id]
        kind, off = rough_of(longest(q), longest(x), x.shape[1])
        for a in range(0, len(q), TILE):
            part, near, found = q[a : a + TILE], q[a : a + TILE].astype(kind), []
            for b in range(0, len(item), PART):
                there, j = x[b : b + PART].astype(kind), None
                if about is not None and len(there) > most:
                    j = np.argpartition(part.astype(np.float32) @ about[b : b + PART].T, len(there) - most, axis=1)[:, len(there) - most :]
                s = near @ there.T if j is None else np.einsum("qcd,qd->qc", there[j], near)
                at, c = _high(s, k, off)
                found.append((at, b + (c if j is None else j[at, c])))
            i, j = (np.concatenate(f) for f in zip(*found, strict=True))
            score = np.einsum("nd,nd->n", x[j], part[i])  # of a pair alone, so equal vectors have equal scores
            order = np.lexsort((j, -score, i))
            i, j, score = i[order], j[order], score[order]
            nth = np.arange(len(i)) - np.searchsorted(i, i)
            best = nth < k
            out.append((asked[a + i[best]], item[j[best]], score[best], np.where(nth[best] == 0, n, 0)))
    return pa.table([np.concatenate(c) for c in zip(*out, strict=True)], names=["query_id", "item_id", "score", "seen"])


def _high(s: np.ndarray, k: int, off: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of scores that may be among the k greatest of their row, if each is off by ``off`` at most."""
    if s.shape[1] <= k:
        return np.nonzero(np.ones(s.shape, dtype=bool))
    return np.nonzero(~(s < (np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] - 2 * off)[:, None]))


def _first_of_codes(code: np.ndarray, most: int) -> np.ndarray:
    """Places of the first ``most`` of each different code, in their order: of copies no more can count."""
    wide = np.zeros((len(code), -(-code.shape[1] // 8) * 8), np.uint8)
    wide[:, : code.shape[1]] = code
    keys = wide.view(np.uint64)
    order = np.lexsort(tuple(keys.T))
    new = np.append(True, (keys[order][1:] != keys[order][:-1]).any(axis=1))
    first = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return np.sort(order[np.arange(len(order)) - first < most])


def _clean(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    return rows.where(F.col("id").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))


def hashed_vectors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dimensions: int = 64) -> DataFrame:
    """(id, vector) of unit length: each text's words hashed to signed dimensions. Texts without words have none. Repeated ids add up."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text_col, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    hashes = docs.select(F.col(id_col).alias("id"), F.transform(words, lambda w: F.xxhash64(w)).alias("h"))

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 2_000):
                part = batch.slice(a, 2_000)
                n, h = part.num_rows, part.column("h").flatten().to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(n), pc.list_value_length(part.column("h")).to_numpy(zero_copy_only=False))
                sums = np.bincount(row * dimensions + h % dimensions, 1.0 - 2.0 * ((h >> 40) & 1), n * dimensions).astype(np.int64)
                ends = pa.array(np.arange(n + 1) * dimensions, pa.int32())
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.ListArray.from_arrays(ends, pa.array(sums))], ["id", "s"])

    sums = hashes.mapInArrow(f, f"id {hashes.schema['id'].dataType.simpleString()}, s array<long>")
    whole = sums.groupBy("id").agg(F.array(*[F.sum(F.col("s")[i]).cast("double") for i in range(dimensions)]).alias("v"))
    size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return whole.where(size > 0).select("id", let(size, lambda n: F.transform("v", lambda x: x / n)).alias("vector"))


def spot_check(index: ProductIndex, exact: DataFrame, queries: DataFrame, k: int, **options) -> DataFrame:
    """(query_id, recall, scanned) of a query set, against the exact hits (query_id, item_id)."""
    found = index.search(queries, k, **options)
    hits = exact.join(found.select("query_id", "item_id", F.lit(1).alias("_hit")), ["query_id", "item_id"], "left")
    recall = hits.groupBy("query_id").agg((F.count("_hit") / F.count(F.lit(1))).alias("recall"))
    return recall.join(found.groupBy("query_id").agg(F.max("scanned").alias("scanned")), "query_id", "left")
