"""Ranking, caps, budgets and keep-best rules, batched by query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n(df: DataFrame, by: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each key; Spark prunes to n rows a key before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= n)


def first_different(df: DataFrame, by: list[str], columns: list[str], n: int, rank: str = "rank") -> DataFrame:
    """The first n different rows (``columns``, in their order, nulls last) of each key: equal rows are next to each other once sorted, so no
    table of the different ones is held."""
    w = Window.partitionBy(*by).orderBy(*[F.asc_nulls_last(c) for c in columns])
    again = F.row_number().over(w) > 1
    for c in columns:
        again = again & F.col(c).eqNullSafe(F.lag(c).over(w))
    return df.select(*by, *columns).withColumns({rank: F.dense_rank().over(w), "_again": again}).where((F.col(rank) <= n) & ~F.col("_again")).drop("_again")


def category_caps(df: DataFrame, query: str, category: str, order: list[Column], caps: dict[str, int], default: int = 30, total: int = 30) -> DataFrame:
    """Walk each query's rows in order, keep a row while its category is under its cap, stop at ``total`` kept.

    A cap keeps a prefix of each category, so ranks within the category and then within what is left say the same.
    """
    cap = F.coalesce(F.create_map(*[F.lit(x) for kv in caps.items() for x in kv])[F.col(category)], F.lit(default)) if caps else F.lit(default)
    kept = df.withColumn("_c", F.row_number().over(Window.partitionBy(query, category).orderBy(*order))).where(F.col("_c") <= cap).drop("_c")
    return top_n(kept, [query], order, total)


def keep_best(df: DataFrame, query: str, group: str, order: list[Column]) -> DataFrame:
    """The first row of each (query, group); rows whose group is empty or null all stay."""
    named = F.coalesce(F.col(group), F.lit("")) != ""
    best = df.where(named).withColumn("_r", F.row_number().over(Window.partitionBy(query, group).orderBy(*order))).where("_r = 1").drop("_r")
    return best.unionByName(df.where(~named))


def seed_groups(df: DataFrame, query: str, group: str, order: list[Column], n: int) -> DataFrame:
    """(query, group, rank): the first n different groups of each query in order."""
    first = top_n(df, [query, group], order, 1, "_first")
    return top_n(first, [query], order, n).select(query, group, "rank")


def within_budget(df: DataFrame, query: str, rank: str, cost: str, budget: int, base: int = 0, most: int = 10) -> DataFrame:
    """Rows taken in rank order while base and costs fit the budget: the first always, none after the first that doesn't fit.

    Costs are at least 1, so running totals only grow and one comparison a row says where the scan would have stopped.
    """
    total = F.lit(base) + F.sum(cost).over(Window.partitionBy(query).orderBy(rank).rowsBetween(Window.unboundedPreceding, 0))
    n = F.row_number().over(Window.partitionBy(query).orderBy(rank))
    return df.withColumns({"total": total, "n": n}).where(((F.col("n") == 1) | (F.col("total") <= budget)) & (F.col("n") <= most)).drop("n")


def first_last(df: DataFrame, by: list[str], order: Column, columns: list[str]) -> DataFrame:
    """One row per key with the first and last value of each column, and the number of rows."""
    ends = [f(F.col(c), order).alias(f"{p}_{c}") for c in columns for p, f in (("first", F.min_by), ("last", F.max_by))]
    return df.groupBy(*by).agg(*ends, F.count(F.lit(1)).alias("n"))


def scaled(df: DataFrame, by: list[str], value: str, out: str = "scaled") -> DataFrame:
    """value scaled to 0..1 in each series; 1 where a series has no range. Extremes are aggregated and joined back."""
    ends = df.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    range_ = F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))
    return df.join(ends, by).withColumn(out, F.coalesce((F.col(value) - F.col("_lo")) / range_, F.lit(1.0))).drop("_lo", "_hi")
