"""Rendered results: context texts, shares, explanations, roll-ups, citation checks, substring joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions.tables import broadcast_if_small
from quillstone.operators.answering import DISCLAIMER
from quillstone.operators.evidence import overall
from quillstone.operators.graph import path_text
from quillstone.operators.ranking import top_n, within_budget
from quillstone.plans.catalog import SQL, query, table
from quillstone.plans.clinical import measurements
from quillstone.plans.retrieval import _HYBRID, evidence_confidence, hybrid

@query(f"""WITH {_HYBRID}, r AS (SELECT b.query_id, b.item_id, d.source, row_number() OVER (PARTITION BY b.query_id ORDER BY b.final DESC, b.item_id) AS rank, greatest(1, length(d.text) // 4)::BIGINT AS tokens FROM best b JOIN documents d ON d.doc_id = b.item_id),
t AS (SELECT *, 150 + sum(tokens) OVER (PARTITION BY query_id ORDER BY rank)::BIGINT AS total FROM r)
SELECT query_id, string_agg('[E' || rank || '] ' || source || '/' || item_id, chr(10) ORDER BY rank) || chr(10) || '{DISCLAIMER}' AS package, count(*) AS blocks FROM t WHERE rank <= 10 AND (rank = 1 OR total <= 2500) GROUP BY query_id""")
def context_package(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed evidence of each query with labels, and the disclaimer if it isn't there yet."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), "source", F.greatest(F.lit(1), F.floor(F.length("text") / 4)).cast("long").alias("tokens"))
    best = top_n(hybrid(spark, sf_dir).join(d, "item_id"), ["query_id"], [F.desc("final"), F.asc("item_id")], 10)
    packed = within_budget(best, "query_id", "rank", "tokens", 2500, 150)
    line = F.format_string("[E%d] %s/%d", F.col("rank"), F.col("source"), F.col("item_id"))
    lines = packed.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", line.alias("line")))).alias("l"), F.count(F.lit(1)).alias("blocks"))  # ten at most
    text = F.array_join(F.transform("l", lambda x: x["line"]), "\n")
    return lines.select("query_id", F.when(text.contains(DISCLAIMER), text).otherwise(F.concat(text, F.lit("\n" + DISCLAIMER))).alias("package"), "blocks")


@query("SELECT l_orderkey, l_linenumber, greatest(5, round(100.0::DOUBLE * l_quantity / sum(l_quantity) OVER (PARTITION BY l_orderkey)))::INT AS share FROM lineitem")
def latency_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's share of its query's total in percent, five at least (lines stand for stages)."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    total = li.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("t"))
    return li.join(total, "l_orderkey").select("l_orderkey", "l_linenumber", F.greatest(F.lit(5), F.round(100.0 * F.col("l_quantity") / F.col("t"))).cast("int").alias("share"))


@query(f"""WITH {_HYBRID} SELECT query_id, count(*) AS citations, count(*) FILTER (canonical LIKE 'PMC%') - count(DISTINCT canonical) FILTER (canonical LIKE 'PMC%') > 0 AS repeated FROM named GROUP BY query_id""")
def citation_hygiene(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a query cites one paper twice before documents are made unique."""
    from quillstone.operators.fusion import canonical_id
    from quillstone.plans.retrieval import _fused

    item = F.col("item_id")
    path = F.when(item % 5 == 0, "").when(item % 5 < 3, F.concat(F.lit("lib/PMC"), F.floor(item / 3).cast("string"), F.lit("_a"))).otherwise(F.concat(F.lit("lib/book/chapter"), F.floor(item / 4).cast("string")))
    pmc = F.when(canonical_id(path).startswith("PMC"), canonical_id(path))
    return _fused(spark, sf_dir).groupBy("query_id").agg(F.count(F.lit(1)).alias("citations"), (F.count(pmc) > F.count_distinct(pmc)).alias("repeated"))


@query("SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean, min(value) AS low, max(value) AS high, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def probe_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 4).alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"), F.count_distinct("user_id").alias("users"))


@query("""SELECT event_id, CASE WHEN value <= 50 * 0.7::DOUBLE OR value >= 120 * 1.5::DOUBLE THEN 'severe' WHEN value < 50 OR value > 120 THEN 'out' ELSE 'in' END AS status,
CASE WHEN value > 120 THEN event_type || ' is above its range (120) by ' || round(value - 120, 2)::DECIMAL(18, 2) WHEN value < 50 THEN event_type || ' is below its range (50) by ' || round(50 - value, 2)::DECIMAL(18, 2) ELSE event_type || ' is within its range' END AS said FROM events""")
def explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The status and a sentence for each measurement against a range of 50 to 120."""
    v = F.col("value")
    status = F.when((v <= 50 * 0.7) | (v >= 120 * 1.5), "severe").when((v < 50) | (v > 120), "out").otherwise("in")
    money = lambda c: F.round(c, 2).cast("decimal(18,2)").cast("string")
    said = F.when(v > 120, F.concat("event_type", F.lit(" is above its range (120) by "), money(v - 120))).when(v < 50, F.concat("event_type", F.lit(" is below its range (50) by "), money(50 - v))).otherwise(F.concat("event_type", F.lit(" is within its range")))
    return measurements(spark, sf_dir).select("event_id", status.alias("status"), said.alias("said"))


@query(f"""WITH c AS (SELECT label, coverage FROM ({SQL["evidence_confidence"]}) JOIN embeddings ON vec_id = query_id), n AS (SELECT label, count(*) FILTER (coverage = 'strong') AS strong, count(*) FILTER (coverage = 'partial') AS partial,
count(*) FILTER (coverage = 'none') AS none, count(*) AS n FROM c GROUP BY label) SELECT label, strong, partial, none, CASE WHEN none = n THEN 'none' WHEN strong = n OR (strong >= 1 AND none = 0) THEN 'strong'
WHEN strong >= 1 OR partial > 0 THEN 'partial' ELSE 'none' END AS overall FROM n""")
def coverage_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of a label's vector queries have enough evidence, and the verdict over them."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), "label")
    return overall(evidence_confidence(spark, sf_dir).join(e, "query_id"), ["label"])


@query("SELECT b.p_brand AS brand, count(*) AS parts, min(p_partkey) AS first FROM (SELECT DISTINCT p_brand FROM part) b JOIN part p ON contains(lower(p.p_brand || ' ' || p.p_type), lower(b.p_brand)) GROUP BY b.p_brand")
def substring_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that hold another's whole name. Names are looked for in the different labels, not in all rows."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.lower(F.concat_ws(" ", "p_brand", "p_type")).alias("label"))
    labels = p.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("low"))
    names = broadcast_if_small(p.select(F.col("p_brand").alias("brand")).distinct(), 10_000)
    return labels.join(names, F.col("label").contains(F.lower("brand"))).groupBy("brand").agg(F.sum("n").alias("parts"), F.min("low").alias("first"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN 'MENTIONS' WHEN l_linenumber % 3 = 1 THEN 'P' || l_partkey || ' -[MENTIONS]-> Document' ELSE 'P' || l_partkey || ' -[MENTIONS]-> S' || l_suppkey END AS path FROM lineitem""")
def path_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, supplier = F.concat(F.lit("P"), F.col("l_partkey").cast("string")), F.concat(F.lit("S"), F.col("l_suppkey").cast("string"))
    entities = F.when(F.col("l_linenumber") % 3 == 0, F.array().cast("array<string>")).when(F.col("l_linenumber") % 3 == 1, F.array(part)).otherwise(F.array(part, supplier))
    text = path_text("MENTIONS", F.col("e"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", entities.alias("e")).select("l_orderkey", "l_linenumber", F.when(F.size("e") == 0, "MENTIONS").otherwise(text).alias("path"))
