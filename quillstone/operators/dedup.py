"""Duplicate elimination, ordered merges and upserts. ``ord`` is always an explicit total order."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.tables import shared_dir, written
from quillstone.operators.ranking import top_n


def content_first(df: DataFrame, content: Column, ord_col: str) -> tuple[DataFrame, DataFrame]:
    """(first row of each content, (original, duplicate) pairs of orders), by SHA-256. Only hashes and orders are shuffled for the pairs."""
    hashed = df.select(F.col(ord_col).alias("ord"), F.sha2(F.coalesce(content.cast("binary"), F.lit(b"")), 256).alias("hash"))
    first = hashed.groupBy("hash").agg(F.min("ord").alias("original"))
    pairs = hashed.join(first, "hash").where("ord <> original").select("original", F.col("ord").alias("duplicate"))
    return first, pairs


def last_wins(df: DataFrame, key: str, ord_col: str) -> DataFrame:
    """One row per key: that of the greatest order."""
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(key).agg(F.max_by(row, F.col(ord_col)).alias("_row")).select("_row.*")


def best_by_priority(df: DataFrame, key: str, priority: str, ord_col: str) -> DataFrame:
    """One row per key: the highest priority, the first of equals."""
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(key).agg(F.min_by(row, F.struct((-F.col(priority)).alias("p"), F.col(ord_col).alias("o"))).alias("_row")).select("_row.*")


def first_non_empty(df: DataFrame, key: str, ord_col: str, columns: list[str]) -> DataFrame:
    """Per key and column: the first value that is neither null nor empty."""
    picked = [F.min_by(F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c)), F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(ord_col))).alias(c) for c in columns]
    return df.groupBy(key).agg(*picked)


def alias_fold(df: DataFrame, key: str, term: str, priority: str, ord_col: str, most: int = 20) -> DataFrame:
    """(key, term, aliases): the term of the highest priority (the first of equals), and as aliases, in order of arrival, the
    other strings that were not the term when they came; a term that a better one replaces is no alias. At most ``most`` aliases.

    The term at each moment is a running maximum, so nothing of a key is gathered but its aliases.
    """
    by_then = F.max(F.struct(F.col(priority).alias("p"), (-F.col(ord_col)).alias("o"), F.col(term).alias("t"))).over(Window.partitionBy(key).orderBy(ord_col).rowsBetween(Window.unboundedPreceding, 0))
    others = df.withColumn("_now", by_then).where(F.col(term) != F.col("_now.t")).groupBy(key, term).agg(F.min(ord_col).alias("_o"))
    aliases = top_n(others, [key], [F.asc("_o")], most, "_r").groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_r", term))).alias("_a"))
    terms = best_by_priority(df, key, priority, ord_col).select(key, term)
    named = F.transform(F.coalesce("_a", F.array().cast(aliases.schema["_a"].dataType)), lambda x: x[term])
    return terms.join(aliases, key, "left").select(key, F.col(term).alias("term"), named.alias("aliases"))


def hash_or_id_first(df: DataFrame, hash_col: str, id_col: str, ord_col: str) -> tuple[DataFrame, DataFrame]:
    """One round of walking rows in order and skipping one whose hash or id a kept row has: (rows sure to be kept, rows still open).

    A skipped row marks nothing. A row that is the first of its hash and of its id is kept whatever the others do; rows
    that share a key with a kept one go; the rest depends on rows that have just gone.
    """
    first_h = df.groupBy(hash_col).agg(F.min(ord_col).alias("_fh"))
    first_i = df.groupBy(id_col).agg(F.min(ord_col).alias("_fi"))
    marked = df.join(first_h, hash_col).join(first_i, id_col)
    # the first of its hash and of its id is kept; one after a kept row of its hash or id goes; what is left is settled in turn
    sure = marked.where((F.col("_fh") == F.col(ord_col)) & (F.col("_fi") == F.col(ord_col)))
    by_hash, by_id = sure.select(hash_col), sure.select(id_col)
    open_ = marked.join(by_hash, hash_col, "left_anti").join(by_id, id_col, "left_anti").select(df.columns)
    return sure.select(df.columns), open_


def _jumped(pointers: DataFrame) -> DataFrame:
    """(ord, end, odd) of (ord, to, odd): where each row's pointers lead, and whether their number is odd. Pointers double each round."""
    now = written(pointers, "pointers")
    while True:
        there = now.select(F.col("ord").alias("to"), F.col("to").alias("_next"), F.col("odd").alias("_odd"))
        step = now.join(there, "to").select("ord", F.col("_next").alias("to"), (F.col("odd") != F.col("_odd")).alias("odd"), (F.col("_next") != F.col("to")).alias("_moved"))
        step = written(step, "pointers")
        now = step.drop("_moved")
        if step.where("_moved").isEmpty():
            return now.withColumnRenamed("to", "end")


def _settled_chains(df: DataFrame, hash_col: str, id_col: str, ord_col: str) -> tuple[DataFrame, DataFrame]:
    """As ``hash_or_id_first``, but a row with one earlier row of its hash or id is kept if that one goes, so whole alternating
    chains of such rows are settled from their first row on."""
    rows = df.select(F.col(hash_col).alias("h"), F.col(id_col).alias("i"), F.col(ord_col).alias("ord"))
    for key in ("h", "i"):
        first = rows.groupBy(key).agg(F.min("ord").alias(f"{key}1"))
        rows = rows.join(first, key)
        second = rows.where(F.col("ord") > F.col(f"{key}1")).groupBy(key).agg(F.min("ord").alias(f"{key}2"))
        rows = rows.join(second, key, "left")
    rows = written(rows, "conflicts")
    before = {k: F.when(F.col("ord") == F.col(f"{k}1"), 0).when(F.col("ord") == F.col(f"{k}2"), 1).otherwise(2) for k in ("h", "i")}
    rows = rows.select("h", "i", "ord", before["h"].alias("bh"), before["i"].alias("bi"), "h1", "i1")
    one = F.when((F.col("bh") == 1) & (F.col("bi") == 0), F.col("h1")).when((F.col("bh") == 0) & (F.col("bi") == 1), F.col("i1"))
    one = one.when((F.col("bh") == 1) & (F.col("bi") == 1) & (F.col("h1") == F.col("i1")), F.col("h1"))
    known = (F.col("bh") == 0) & (F.col("bi") == 0)
    rows = rows.withColumns({"to": F.coalesce(one, F.col("ord")), "odd": one.isNotNull(), "known": known})
    ends = _jumped(rows.select("ord", "to", "odd"))
    told = ends.join(rows.where("known").select(F.col("ord").alias("end")), "end", "left_semi")
    told = written(told.select(F.col("ord").alias(ord_col), (~F.col("odd")).alias("_kept")), "told")
    sure = df.join(told.where("_kept").select(ord_col), ord_col, "left_semi")
    open_ = df.join(told.select(ord_col), ord_col, "left_anti").join(sure.select(hash_col), hash_col, "left_anti").join(sure.select(id_col), id_col, "left_anti")
    return sure.select(df.columns), open_.select(df.columns)


def settle(df: DataFrame, hash_col: str, id_col: str, ord_col: str, plain_rounds: int = 2) -> DataFrame:
    """``hash_or_id_first`` until nothing is open. After ``plain_rounds``, which most tables don't outlast, whole chains of conflicts are
    settled at once by pointers that double, so a chain of n rows takes about log n joins of the rows that are still open.
    ``ord`` is different in each row. What a round settles is added to one table, so the result is one scan."""
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}/settled-{uuid.uuid4().hex}"
    open_, rounds = df, 0
    while True:
        sure, left = (hash_or_id_first if rounds < plain_rounds else _settled_chains)(open_, hash_col, id_col, ord_col)
        sure.write.mode("append").parquet(path)
        open_, rounds = written(left, "open"), rounds + 1
        if open_.isEmpty():
            return spark.read.schema(df.schema).parquet(path)


def upsert(old: DataFrame, new: DataFrame, key: str, ord_col: str) -> DataFrame:
    """Rows of ``old`` replaced by those of ``new`` with their key; new keys added; of a key's new rows the last."""
    fresh = last_wins(new, key, ord_col)
    return old.join(fresh.select(key), key, "left_anti").unionByName(fresh)


def unprocessed(files: DataFrame, log: DataFrame, path_col: str = "path", status_col: str = "status") -> DataFrame:
    """Files whose path the log doesn't have as a success."""
    return files.join(log.where(F.col(status_col) == "success").select(path_col).distinct(), path_col, "left_anti")
