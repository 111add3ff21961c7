"""Near-duplicate embeddings: random-hyperplane signs in several tables, exact cosine, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from quillstone.llm.components import connected_components
from quillstone.llm.shared import Stage, in_blocks, runs

#: Bits of a table's code and number of tables. At cosine 0.98 a bit agrees with probability 0.936, so a pair shares no
#: code of 16 bits in any of 32 tables with probability 1e-6.
BITS, TABLES, BLOCK = 16, 32, 512


def planes(dim: int, bits: int, tables: int, seed: int = 5) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, bits * tables))


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of 2, so that the largest component is near 1: no square over- or underflows, and no digit changes."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0))[1][:, None])


def _signs(x: np.ndarray, bits: int, tables: int, seed: int) -> np.ndarray:
    """The code of each vector in each table."""
    key = (x.shape[1], bits, tables, seed)
    if key not in _PLANES:
        _PLANES[key] = planes(*key)
    power = 1 << np.arange(bits, dtype=np.int64)
    return ((x @ _PLANES[key] > 0).reshape(len(x), tables, bits) * power).sum(axis=2)


_PLANES: dict[tuple, np.ndarray] = {}


def _codes(batches: Iterator[pd.DataFrame], bits: int, tables: int, seed: int, kind: str) -> Iterator[pd.DataFrame]:
    for batch in batches:
        sizes = batch["vector"].map(len).to_numpy()
        for dim in np.unique(sizes):
            part = batch[sizes == dim]
            x = np.array(part["vector"].tolist(), dtype=np.float64)
            codes = _signs(scaled(x), bits, tables, seed)
            packed = list(map(bytes, x.astype(kind)))
            yield pd.DataFrame({"rep": part["rep"], "label": part["label"], "packed": packed, "copies": part["copies"], "item": part["item"], "codes": list(map(bytes, codes.astype("<u4"))), "code": codes.tolist()})


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For items 0..n-1 in id order: the smallest item linked to each by (a, b)."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, a, root[b])
        np.minimum.at(low, b, root[a])
        low = low[low]
        if (low == root).all():
            return root
        root = low


def _links(batches: Iterator[pd.DataFrame], threshold: float, kind: str) -> Iterator[pd.DataFrame]:
    """For each item of a run: weighted links first met here, and the smallest id it is linked to."""
    out: list[tuple] = []
    size = 0
    for run in runs(batches, ["bucket", "p", "q"]):
        n = len(run)
        if n < 2:
            continue
        run = run.sort_values("rep", kind="stable")
        rep, copies, table = run["rep"].to_numpy(), run["copies"].to_numpy(), int(run["table"].iat[0])
        x = scaled(np.frombuffer(b"".join(run["packed"]), dtype=kind).reshape(n, -1).astype(np.float64))
        norm = np.sqrt((x * x).sum(axis=1))
        unit = x / norm[:, None]
        near = np.triu(unit @ unit.T >= threshold - 1e-9, 1)  # the slack is far above rounding; the exact test follows
        label = run["label"].to_numpy()
        near &= label[:, None] == label[None, :]  # two labels' buckets may clash
        if run["p"].iat[0] != run["q"].iat[0]:
            part = run["part"].to_numpy()
            near &= part[:, None] != part[None, :]
        a, b = np.nonzero(near)
        if not len(a):
            continue
        cosine = (x[a] * x[b]).sum(axis=1) / (norm[a] * norm[b])
        a, b = a[cosine >= threshold], b[cosine >= threshold]
        if not len(a):
            continue
        codes = np.frombuffer(b"".join(run["codes"]), dtype="<u4").reshape(n, -1)[:, :table]
        new = ~(codes[a] == codes[b]).any(axis=1) if table else np.ones(len(a), dtype=bool)
        links = np.bincount(a[new], copies[b[new]], n) + np.bincount(b[new], copies[a[new]], n)
        root = local_roots(n, a, b)
        some = (links > 0) | (root != np.arange(n))
        out.append((rep[some], links[some].astype(np.int64), rep[root[some]]))
        size += int(some.sum())
        if size > 20_000:
            yield pd.DataFrame({k: np.concatenate(v) for k, v in zip(("id", "links", "root"), zip(*out, strict=True), strict=True)})
            out, size = [], 0
    if out:
        yield pd.DataFrame({k: np.concatenate(v) for k, v in zip(("id", "links", "root"), zip(*out, strict=True), strict=True)})


def embedding_near_dedup(
    spark: SparkSession, vectors: DataFrame, threshold: float = 0.98, bits: int = BITS, tables: int = TABLES, block: int = BLOCK, seed: int = 5,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label",
) -> DataFrame:
    """One row per row of ``vectors``: its id, n_links, component_id, kept, and n_copies (equal vectors, itself included).

    Vectors of one label (null labels link with nothing; without ``label_col`` all are compared) whose cosine in
    double precision is at least ``threshold`` are linked, whatever their size (1e-200 or 1e200). Candidates share a sign code in one of ``tables`` tables.
    Equal vectors are collapsed first and counted as links to each other. A bucket is compared in pairs of blocks of
    ``block`` items, and a pair counts only in the first table whose code it shares, so pairs are never written:
    each run returns a count and a root per item.

    Null, zero, non-finite or empty vectors, and those with a null label, link with nothing: n_links 0, own
    component, kept. Vectors of different lengths never link. A null id is returned with null component and kept
    true. A repeated id takes the same result in each of its rows and repeats count as one vector per distinct
    content. An empty table gives no rows. Other columns are ignored.
    """
    stage = Stage(spark, "embedding-dedup")
    label = F.col(label_col).cast("string") if label_col else F.lit("")
    rows = vectors.select(F.col(id_col).cast("long").alias("rid"), label.alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    fine = F.coalesce((F.size("vector") > 0) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0), F.lit(False))
    valid = rows.where(F.col("rid").isNotNull() & F.col("label").isNotNull() & fine)
    valid = valid.withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0)))  # -0.0 is 0.0
    ids = stage.cut(valid.select("rid", "label", F.sha2(F.concat_ws(",", F.transform("vector", lambda x: x.cast("string"))), 256).alias("content"), "vector"), "valid")
    group = ids.groupBy("label", "content").agg(F.min("rid").alias("rep"), F.countDistinct("rid").alias("copies"))
    reps = ids.join(group, ["label", "content"]).where("rid = rep").dropDuplicates(["rep", "label", "content"])
    held = vectors.schema[vector_col].dataType
    kind = "<f4" if isinstance(held, ArrayType) and isinstance(held.elementType, FloatType) else "<f8"  # no digit is lost
    coded = reps.select("rep", "label", "vector", "copies", F.monotonically_increasing_id().alias("item")).mapInPandas(
        lambda it: _codes(it, bits, tables, seed, kind), "rep long, label string, packed binary, copies long, item long, codes binary, code array<long>"
    )
    coded = stage.cut(coded, "coded")
    keys = coded.select("item", "label", F.length("packed").alias("length"), F.posexplode("code").alias("table", "c")).select(F.xxhash64("label", "length", "table", "c").alias("bucket"), "table", "item")
    dealt = in_blocks(keys, "bucket", "item", block)
    dealt = dealt.join(coded.select("item", "rep", "label", "packed", "copies", "codes"), "item")
    found = dealt.repartition("bucket", "p", "q").sortWithinPartitions("bucket", "p", "q").mapInPandas(lambda it: _links(it, threshold, kind), "id long, links long, root long")
    found = stage.cut(found, "found")
    part = connected_components(found.select(F.col("id").alias("src"), F.col("root").alias("dst")), stage)
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    of_rep = group.join(links.withColumnRenamed("id", "rep"), "rep", "left").join(part.withColumnRenamed("id", "rep"), "rep", "left")
    of_rep = of_rep.select("label", "content", "rep", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component_id", "rep").alias("component_id"))
    done = ids.select("rid", "label", "content").join(of_rep, ["label", "content"])
    done = done.groupBy("rid").agg((F.max(F.col("links") + F.col("copies")) - 1).alias("n_links"), F.min("component_id").alias("component_id"), F.max("copies").alias("n_copies"))
    out = rows.select("rid").join(done, "rid", "left")
    own = F.coalesce("component_id", "rid")
    return out.select(
        F.col("rid").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"),
        F.coalesce(own == F.col("rid"), F.lit(True)).alias("kept"), F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"),
    )
