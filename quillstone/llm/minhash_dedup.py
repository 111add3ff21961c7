"""Near-duplicate texts: b-bit MinHash signatures joined by a multi-index Hamming join, confirmed on full shingle sets.

A signature has chunks x symbols minima of 16 bits, in a shape that follows from the threshold. Two sets at Jaccard
similarity J differ in a symbol with probability 1 - J, so at J = 0.85 signatures of 11 x 6 symbols differ in about 10 of
66, and in more than the radius of 21 with probability 1.6e-4; at J = 0.80 those of 14 x 5 do in more than 27 of 70 with
probability 1e-4. That is what a pair at the threshold is missed with; closer pairs are missed less. By pigeonhole, of c
chunks one has at most one error when at most 2c - 1 symbols differ; the join enumerates that error (each of a chunk's
symbols masked in turn), so every pair within the radius shares a key. That is a guarantee, not a probability: what it
finds is every pair of signatures within the radius.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.components import connected_components
from quillstone.llm.embedding_dedup import local_roots
from quillstone.llm.shared import Stage, arrow_map, broadcast_if_small, distinct, in_blocks, mix, numbers, passes, prefix_sums, runs, shingles, span_hashes, words

WIDTH, BLOCK = 5, 512
#: Probability with which a pair at the threshold may lie outside the radius, and chunks of a signature at most.
MISS, MOST_CHUNKS = 1.6e-4, 20


class Shape(NamedTuple):
    """Chunks of a signature and symbols of a chunk."""

    chunks: int
    symbols: int

    @property
    def size(self) -> int:
        return self.chunks * self.symbols

    @property
    def radius(self) -> int:
        """Every pair of signatures with at most this many differing symbols shares a key."""
        return 2 * self.chunks - 1

    def miss(self, similarity: float) -> float:
        """Probability that the signatures of a pair at this similarity differ in more symbols than the radius."""
        return sum(comb(self.size, k) * (1 - similarity) ** k * similarity ** (self.size - k) for k in range(self.radius + 1, self.size + 1))


def shape_for(percent: int) -> Shape:
    """The longest chunks, and as few of them, that miss a pair at ``percent`` with probability MISS at most."""
    for symbols in (6, 5, 4, 3):
        for chunks in range(1, MOST_CHUNKS + 1):
            if Shape(chunks, symbols).miss(percent / 100) <= MISS:
                return Shape(chunks, symbols)
    raise ValueError(f"no signature of at most {MOST_CHUNKS} chunks finds pairs at {percent} %")


SHAPE = shape_for(85)
CHUNKS, SYMBOLS, RADIUS = *SHAPE, SHAPE.radius


def text_sets(column: pa.Array, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, sorted distinct shingle hashes, bounds per row)."""
    for a, b, data, offsets in passes(column):
        starts, ends, bounds = words(data, offsets)
        h, cut = shingles(span_hashes(prefix_sums(data), starts, ends), bounds, width)
        yield a, b, *distinct(h, cut)


def signatures(sets: np.ndarray, bounds: np.ndarray, n: int) -> np.ndarray:
    """16 bits of the minimum of each of n hashes over each non-empty set; zeros for empty ones."""
    full = np.flatnonzero(np.diff(bounds) > 0)
    out = np.zeros((len(bounds) - 1, n), dtype="<u2")
    if len(full):
        for k, a in enumerate(numbers(101, n)):
            out[full, k] = mix(np.minimum.reduceat(sets * a, bounds[full])) & np.uint64(0xFFFF)
    return out


def _sign(width: int, shape: Shape):
    def f(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for a, b, sets, bounds in text_sets(batch.column(1), width):
            n = np.diff(bounds)
            sums = np.zeros((2, b - a), dtype=np.uint64)
            full = np.flatnonzero(n > 0)
            if len(full):
                for i, salt in enumerate((3, 5)):
                    sums[i, full] = np.add.reduceat(mix(sets + np.uint64(salt)), bounds[full])
            sig = signatures(sets, bounds, shape.size)
            columns = [batch.column(0).slice(a, b - a), pa.array(n.astype(np.int64)), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), pa.array([x.tobytes() for x in sig])]
            yield pa.RecordBatch.from_arrays(columns, ["rid", "n", "f1", "f2", "sig"])

    return f


def _sets(width: int):
    def f(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for a, b, sets, bounds in text_sets(batch.column(1), width):
            mark = [int(mix(sets[i:j]).sum(dtype=np.uint64).view(np.int64)) for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
            held = pa.array([sets[i:j].tobytes() for i, j in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(mark, pa.int64()), held], ["rid", "f1", "set"])

    return f


def chunk_keys(sig: np.ndarray, shape: Shape = SHAPE) -> np.ndarray:
    """A row's keys: for each chunk and each of its symbols, the others' values."""
    s = mix(sig.reshape(-1, *shape).astype(np.uint64) + np.uint64(1)) * numbers(202, shape.size).reshape(shape)
    left = s.sum(axis=2, keepdims=True, dtype=np.uint64) - s
    return mix(left + np.arange(shape.size, dtype=np.uint64).reshape(shape) * np.uint64(0x9E3779B97F4A7C15)).reshape(len(sig), -1)


def _symbols(column, shape: Shape) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype="<u2").reshape(len(column), shape.size)


def _keyed(shape: Shape):
    def f(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for a in range(0, batch.num_rows, 2000):
            part = batch.slice(a, 2000)
            keys = chunk_keys(_symbols(part.column(1).to_pylist(), shape), shape).view(np.int64)
            m = keys.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column(0).to_numpy(), m)), pa.array(keys.ravel())], ["rep", "key"])

    return f


def _near(shape: Shape):
    """Pairs whose signatures are within the radius."""

    def f(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        near = (_symbols(batch.column("sig_a").to_pylist(), shape) != _symbols(batch.column("sig_b").to_pylist(), shape)).sum(axis=1) <= shape.radius
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(near))

    return f


def _linked(percent: int):
    def f(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ok = [linked(np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64), percent) for x, y in zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["src", "dst"]).filter(pa.array(ok, pa.bool_()))

    return f


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have 100 * |x & y| >= percent * |x | y|, in whole numbers."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x) or 100 * len(x) < percent * len(y):
        return False
    at = np.searchsorted(y, x)
    both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _open_pairs(run: pd.DataFrame, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """A run's pairs to confirm: of different components, within the radius, and of no earlier shared key."""
    n, sig, comp = len(run), _symbols(run["sig"].tolist(), shape), run["component_id"].to_numpy()
    part, crossed, key = run["part"].to_numpy(), run["p"].iat[0] != run["q"].iat[0], run["key"].iat[0]
    keys = chunk_keys(sig, shape).view(np.int64)
    rank = int(np.argwhere(keys == key)[0][1])
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for i in range(n - 1):
        j = np.arange(i + 1, n)
        j = j[(comp[j] != comp[i]) & ((part[j] != part[i]) if crossed else True)]
        if len(j):
            j = j[(sig[j] != sig[i]).sum(axis=1) <= shape.radius]
        if len(j) and rank:
            j = j[~(keys[j, :rank] == keys[i, :rank]).any(axis=1)]
        if len(j):
            found.append((np.full(len(j), i), j))
    if not found:
        return np.zeros(0, int), np.zeros(0, int)
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def _marked(shape: Shape):
    """Of each run, the members that have a pair to confirm."""

    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[pd.DataFrame] = []
        for run in runs(batches, ["key", "p", "q"]):
            if run["component_id"].nunique() < 2:
                continue
            a, b = _open_pairs(run, shape)
            if len(a):
                out.append(run.iloc[np.unique(np.concatenate([a, b]))])
            if len(out) >= 500:
                yield pd.concat(out)
                out = []
        if out:
            yield pd.concat(out)

    return f


def _confirmed(percent: int, shape: Shape):
    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for run in runs(batches, ["key", "p", "q"]):
            a, b = _open_pairs(run, shape)
            sets = [np.frombuffer(x, dtype=np.uint64) for x in run["set"]]
            root, edges = run["component_id"].to_numpy().copy(), []
            for i, j in zip(a.tolist(), b.tolist(), strict=True):
                if root[i] != root[j] and linked(sets[i], sets[j], percent):
                    edges.append((i, j))
                    root[root == root[j]] = root[i]
            if edges:
                rep = run["rep"].to_numpy()
                yield pd.DataFrame({"src": rep[[i for i, _ in edges]], "dst": rep[[j for _, j in edges]]})

    return f


def minhash_near_dedup(
    spark: SparkSession, docs: DataFrame, percent: int = 85, width: int = WIDTH, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: its id, n_shingles, component_id and kept (its id is the component's smallest).

    Texts are linked when 100 * |intersection| >= percent * |union| of their sets of distinct ``width``-word shingles
    (words are runs of non-white ASCII-space characters, A-Z in lower case; a shorter text is one shingle as a whole).

    1. Equal sets collapse to the smallest id. 2. Signatures are keyed; members of a key are first tried against the
    key's smallest member, confirmed on the full sets, and the components of these links found. A large group of close
    copies is done by that, in time linear in its size. 3. Keys that still hold several components are compared in
    pairs of bounded blocks; only members with a pair within the radius take their sets along, and every such pair is
    confirmed unless its ends are already connected. No pair of different components within the radius is left out; a pair
    at ``percent`` lies outside it with probability MISS at most, whatever ``percent`` is (from 60 on; below is refused).

    Null or blank texts have n_shingles 0, link with nothing and are kept. A null id keeps null component and is kept.
    A repeated id is one document with several texts: what links to any of them links to it. An empty table
    gives no rows. Other columns are ignored.
    """
    stage = Stage(spark, "minhash-dedup")
    shape = shape_for(percent)
    texts = docs.select(F.col(id_col).cast("long").alias("rid"), F.col(text_col).cast("string").alias("text"))
    base = stage.cut(arrow_map(texts, _sign(width, shape), "rid long, n long, f1 long, f2 long, sig binary"), "base")
    full = base.where("n > 0 and rid is not null")
    reps = stage.cut(full.groupBy("f1", "f2", "n", "sig").agg(F.min("rid").alias("rep")), "reps")
    keys = arrow_map(reps.select("rep", "sig"), _keyed(shape), "rep long, key long")
    common = keys.groupBy("key").agg(F.min("rep").alias("lead"), F.max("rep").alias("_last")).where("lead <> _last").drop("_last")
    shared = stage.cut(keys.join(common, "key").select("key", "rep", "lead"), "shared")

    sigs = reps.select("rep", "sig")
    star = shared.where("rep <> lead").select(F.col("rep").alias("a"), F.col("lead").alias("b")).distinct()
    star = star.join(sigs.select(F.col("rep").alias("a"), F.col("sig").alias("sig_a")), "a").join(sigs.select(F.col("rep").alias("b"), F.col("sig").alias("sig_b")), "b")
    star = stage.cut(arrow_map(star.select("a", "b", "sig_a", "sig_b"), _near(shape), "a long, b long").distinct(), "star")
    members = stage.cut(shared.select(F.col("rep").alias("rid")).distinct(), "members")
    narrow = broadcast_if_small(members, members.count())
    sets = arrow_map(texts.join(narrow, "rid", "left_semi"), _sets(width), "rid long, f1 long, set binary")
    sets = stage.cut(sets.groupBy("rid", "f1").agg(F.first("set").alias("set")), "sets")
    pairs = star.join(sets.select(F.col("rid").alias("a"), F.col("set").alias("set_a")), "a").join(sets.select(F.col("rid").alias("b"), F.col("set").alias("set_b")), "b")
    edges = stage.cut(arrow_map(pairs.select("a", "b", "set_a", "set_b"), _linked(percent), "src long, dst long"), "edges")
    part = connected_components(edges, stage, "first")

    placed = shared.select("key", "rep").join(part.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component_id", F.coalesce("component_id", "rep"))
    mixed = placed.groupBy("key").agg(F.min("component_id").alias("_l"), F.max("component_id").alias("_h")).where("_l <> _h").select("key")
    unsettled = stage.cut(placed.join(mixed, "key"), "unsettled")
    dealt = in_blocks(unsettled, "key", "rep", block).join(sigs.select("rep", "sig"), "rep")
    run_columns = "rep long, component_id long, key long, part int, p int, q int, sig binary"
    dealt = dealt.select("rep", "component_id", "key", "part", "p", "q", "sig").repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")
    marked = stage.cut(dealt.mapInPandas(_marked(shape), run_columns), "marked")
    held = marked.join(sets.withColumnRenamed("rid", "rep"), "rep").repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")
    more = stage.cut(held.mapInPandas(_confirmed(percent, shape), "src long, dst long"), "more")
    links = edges.unionByName(more)
    part = connected_components(links, stage, "last")

    of_set = reps.join(part.withColumnRenamed("id", "rep"), "rep", "left").select("f1", "f2", "n", "sig", F.coalesce("component_id", "rep").alias("component_id"))
    of_id = full.join(of_set, ["f1", "f2", "n", "sig"]).groupBy("rid").agg(F.min("component_id").alias("component_id"))
    out = base.join(of_id, "rid", "left")
    own = F.coalesce("component_id", "rid")
    return out.select(F.col("rid").alias(id_col), F.col("n").alias("n_shingles"), own.alias("component_id"), F.coalesce(own == F.col("rid"), F.lit(True)).alias("kept"))
