"""Extensions beside the retrieval system's own operators: windows over events, cubes, set operations, frames, an as-of join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.plans.catalog import query, table
from quillstone.streaming.flows import first_seen, sessions, sliding, tumbling


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def ext_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tumbling(table(spark, sf_dir, "events")).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT date_trunc('day', ts) - INTERVAL 1 DAY * k AS start, event_type, count(*) AS n FROM events, (VALUES (0), (1)) s(k) GROUP BY ALL")
def ext_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sliding(table(spark, sf_dir, "events")).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""SELECT min(ts) AS start, user_id, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s""")
def ext_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(table(spark, sf_dir, "events")).select(F.col("start").cast("timestamp_ntz").alias("start"), "user_id", "n")


@query("SELECT DISTINCT user_id, event_type FROM events")
def ext_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_seen(table(spark, sf_dir, "events"), ["user_id", "event_type"]).select("user_id", "event_type")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def ext_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY CUBE (p_brand, p_type)")
def ext_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").cube("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 0")
def ext_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(spark, sf_dir, "supplier").where("s_acctbal > 0").select("s_nationkey"))


@query("SELECT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R' EXCEPT ALL SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A'")
def ext_except_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("k")).exceptAll(li.where("l_returnflag = 'A'").select("l_partkey"))


@query("SELECT event_id, value - lag(value) OVER w AS change, ntile(4) OVER w AS quarter, round(avg(value) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS smooth FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)")
def ext_window_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("event_id", (F.col("value") - F.lag("value").over(w)).alias("change"), F.ntile(4).over(w).alias("quarter"), F.round(F.avg("value").over(w.rowsBetween(-2, 0)), 4).alias("smooth"))


@query("""SELECT p.event_id, arg_max(v.value, (v.ts, v.event_id)) AS last_view FROM events p LEFT JOIN events v ON v.user_id = p.user_id AND v.event_type = 'view' AND v.ts <= p.ts WHERE p.event_type = 'purchase' GROUP BY p.event_id""")
def ext_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase with its user's last view before it: one window over both kinds, no range join."""
    e = table(spark, sf_dir, "events").where("event_type in ('purchase', 'view')")
    w = Window.partitionBy("user_id").orderBy("ts", F.col("event_type") == "purchase", "event_id")
    seen = e.withColumn("last_view", F.last(F.when(F.col("event_type") == "view", F.col("value")), ignorenulls=True).over(w))
    return seen.where("event_type = 'purchase'").select("event_id", "last_view")
