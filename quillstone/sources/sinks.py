"""Writers: idempotent tables, append-only logs, encrypted rows, deletions by age."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_documents(df: DataFrame, path: str, by: str = "source", kind: str = "parquet") -> None:
    """Documents by source; a source that is written again replaces its own part only."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).format(kind).save(path)


def append_log(df: DataFrame, path: str) -> None:
    """Rows of a processing or failure log; earlier rows stay as they are."""
    df.withColumn("logged_at", F.current_timestamp()).write.mode("append").parquet(path)


def write_vectors(df: DataFrame, path: str, cell: str = "cell") -> None:
    """Indexed vectors by cell, so that a search reads the cells it probes."""
    df.repartition(cell).write.mode("overwrite").partitionBy(cell).parquet(path)


def write_edges(df: DataFrame, table: str, buckets: int = 64) -> None:
    """An edge table bucketed by its source, for joins without another shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, "src").sortBy("src").saveAsTable(table)


def encrypted(payload: Column, key: Column) -> Column:
    """AES-GCM of a text; the nonce is random and stands first."""
    return F.aes_encrypt(payload, key, F.lit("GCM"))


def decrypted(blob: Column, key: Column) -> Column:
    return F.aes_decrypt(blob, key, F.lit("GCM")).cast("string")


def without_expired(df: DataFrame, owner: str, at: str, now: Column, seconds: int, prefix: str = "guest_") -> DataFrame:
    """Rows without those of guests that are older than ``seconds``."""
    old = F.col(owner).startswith(prefix) & (F.unix_timestamp(now) - F.unix_timestamp(F.col(at).cast("timestamp")) > seconds)
    return df.where(~F.coalesce(old, F.lit(False)))


def export(df: DataFrame, path: str, kind: str = "csv") -> None:
    df.write.mode("overwrite").option("header", True).format(kind).save(path)


def table_counts(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(name, n) of written tables."""
    out: DataFrame | None = None
    for name, path in paths.items():
        one = spark.read.parquet(path).groupBy(F.lit(name).alias("name")).agg(F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out
