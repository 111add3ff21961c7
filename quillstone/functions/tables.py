"""Tables on the way: written to the shared folder to cut lineage, broadcast only if their counted size allows it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; on one machine, a folder set here if there is none."""
    held = spark.conf.get("spark.checkpoint.dir", None)
    if held is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        held = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", held)
    return held.rstrip("/")


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """The rows of ``df``, written once and read from there."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, most: int = 500_000) -> DataFrame:
    """A broadcast hint if ``df`` has at most ``most`` rows (counted, up to one more); else Spark shuffles."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def tasks_for(df: DataFrame, rows: int = 1_000_000) -> int:
    """In how many tasks ``df`` should be shuffled, so that each gets about ``rows`` rows (counted); the session's number at least."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows))


def numbered(df: DataFrame, order: list[str], name: str, start: int = 1) -> DataFrame:
    """``df`` with each row's place in an order (whose rows are all different): ranges are numbered apart and moved by the sizes of those before."""
    ranges = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_range", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id())
    ranges = written(ranges, "ranges")
    sizes = ranges.groupBy("_range").agg(F.count(F.lit(1)).alias("_c"), F.min("_i").alias("_low"), F.min(F.struct(*order)).alias("_first"))
    before = sizes.select("_range", "_low", F.expr("coalesce(sum(_c) over (order by _first rows between unbounded preceding and 1 preceding), 0)").alias("_before"))  # a row per range
    return ranges.join(F.broadcast(before), "_range").withColumn(name, F.col("_i") - F.col("_low") + F.col("_before") + start).drop("_range", "_i", "_low", "_before")
