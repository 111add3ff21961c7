"""Distributed connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.shared import Stage


def _state(edges: DataFrame) -> tuple:
    h = F.xxhash64("u", "v").cast("decimal(38,0)")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(h)).first())


def connected_components(edges: DataFrame, stage: Stage, name: str = "cc", src: str = "src", dst: str = "dst", most: int = 60) -> DataFrame:
    """(id, component_id) of each end of an edge; component_id is the smallest id reachable.

    Rows with a null end and loops are left out; repeated edges count once; no edges give no rows. Each step is a
    minimum per vertex (combined before the shuffle) joined back to the edges, so a vertex with a third of all edges
    is a skewed join side that adaptive execution splits, never one task's group. The edges are written to the shared
    folder after each step. Raises if ``most`` steps don't settle (they are O(log^2 n)).
    """
    e = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst)))
    e = e.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).distinct()
    e, before = stage.cut(e, f"{name}-0"), None
    now, step = _state(e), 0
    while now != before and now[0]:
        if step >= most:
            raise RuntimeError(f"components did not settle in {most} steps")
        # large star: each vertex's larger neighbours go to its smallest neighbour (itself included)
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: each vertex's smaller neighbours, and itself, go to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        small = small.union(low.select("u", F.col("m").alias("v"))).distinct()
        step += 1
        e = stage.cut(small, f"{name}-{step}")
        stage.drop(f"{name}-{step - 1}")
        before, now = now, _state(e)
    roots = e.select(F.col("v").alias("id")).distinct().withColumn("component_id", F.col("id"))
    return e.select(F.col("u").alias("id"), F.col("v").alias("component_id")).unionByName(roots)
