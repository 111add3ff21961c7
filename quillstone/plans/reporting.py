"""Queries of ingest reports, routing and what it leaves out, external ids, citation and latency checks, signed changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators.fusion import blocked
from quillstone.operators.reporting import dated_rate, external_ids, signed, summary_report, target, vector_rows, with_codes, without_prefixes
from quillstone.plans.catalog import query, table

_STATUS = "CASE quality WHEN 1 THEN 'Success ' WHEN 0 THEN 'failed' ELSE 'skipped' END"


@query(f"""WITH f AS (SELECT source AS folder, lang AS kind, trim(lower({_STATUS})) AS s FROM documents LEFT JOIN labels USING (doc_id))
SELECT CASE WHEN GROUPING(folder) = 0 THEN 'folder' WHEN GROUPING(kind) = 0 THEN 'format' ELSE 'all' END AS section, coalesce(folder, kind, '') AS name, count(*) FILTER (s = 'success') AS succeeded,
count(*) FILTER (s = 'failed') AS failed, count(*) FILTER (s = 'skipped') AS skipped, count(*) AS total FROM f GROUP BY GROUPING SETS ((folder), (kind), ())""")
def ingest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of read, failed and skipped documents by folder (source), format (language) and in all."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return summary_report(d.withColumn("status", F.expr(_STATUS)), "source", "lang", "status")


_KINDS = ["guideline", "ontology", "lab_reference", "clinical_note", "image"]
_CAT = "CASE doc_id % 5 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(_KINDS)) + " END"
_TARGET = """CASE WHEN coalesce(lang, 'en') <> 'en' THEN 'none' WHEN v AND g THEN 'both' WHEN v THEN 'faiss' WHEN g THEN 'graph' ELSE 'none' END"""
_ROUTED = f"""r AS (SELECT doc_id, lang, category IN ('guideline', 'clinical_note') OR (category = 'lab_reference' AND length(text) > 200) AS v, category IN ('ontology', 'lab_reference', 'clinical_note') OR n > 0 AS g
  FROM (SELECT *, {_CAT} AS category, CASE WHEN doc_id % 7 = 0 THEN 2 ELSE 0 END AS n FROM documents)), t AS (SELECT doc_id, lang, {_TARGET} AS target FROM r)"""


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "text", F.expr(_CAT).alias("category"), F.when(F.col("doc_id") % 7 == 0, 2).otherwise(0).alias("n"))
    return d.select("doc_id", "lang", target(F.col("category"), F.col("text"), F.col("n"), F.col("lang")).alias("target"))


@query(f"WITH {_ROUTED} SELECT doc_id, target FROM t")
def structured_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which index a document goes to, by category, its tables' rows, its length and language."""
    return _targets(spark, sf_dir).select("doc_id", "target")


@query(f"WITH {_ROUTED} SELECT count(*) FILTER (coalesce(lang, 'en') = 'en' AND target IN ('faiss', 'both')) AS kept, count(*) FILTER (coalesce(lang, 'en') <> 'en') AS other_language, count(*) FILTER (coalesce(lang, 'en') = 'en' AND target NOT IN ('faiss', 'both')) AS other_target FROM t")
def vector_row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents the vector index takes, and how many a language or a target leaves out."""
    return vector_rows(_targets(spark, sf_dir))[1]


@query("""WITH c AS (SELECT CASE doc_id % 5 WHEN 0 THEN 'bench_' WHEN 1 THEN 'bench_test_' WHEN 2 THEN 'qa-' ELSE 'doc_' END || doc_id || '__c0' AS id FROM documents)
SELECT CASE WHEN starts_with(id, 'bench_test_') THEN 'bench_test_' WHEN starts_with(id, 'bench_') THEN 'bench_' ELSE 'qa-' END AS prefix, count(*) AS excluded FROM c WHERE starts_with(id, 'bench_') OR starts_with(id, 'qa-') GROUP BY 1""")
def excluded_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks left out of an evaluation by the beginnings of their ids."""
    kind = F.when(F.col("doc_id") % 5 == 0, "bench_").when(F.col("doc_id") % 5 == 1, "bench_test_").when(F.col("doc_id") % 5 == 2, "qa-").otherwise("doc_")
    rows = table(spark, sf_dir, "documents").select(F.concat(kind, F.col("doc_id").cast("string"), F.lit("__c0")).alias("id"))
    return without_prefixes(rows, "id", ["bench_test_", "bench_", "qa-"])[1]


@query("""WITH k AS (SELECT lower(trim(' ' || p_name || ' ')) AS n, arg_max(p_partkey, p_partkey) AS id FROM part WHERE p_size > 10 AND p_brand <> 'Brand#1' GROUP BY 1)
SELECT o_orderkey, coalesce(k.id::VARCHAR, 'O' || o_orderkey) AS external_id FROM (SELECT o_orderkey, upper(p_name) || ' ' AS name FROM orders JOIN part ON p_partkey = o_orderkey % 50) LEFT JOIN k ON k.n = lower(trim(name))""")
def external_drug_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names looked up in a table of which the last row of a name counts; those unknown keep their own id."""
    o, p = table(spark, sf_dir, "orders"), table(spark, sf_dir, "part")
    few = F.broadcast(p.where("p_partkey < 50").select("p_partkey", F.concat(F.upper("p_name"), F.lit(" ")).alias("name")))  # 50 rows
    items = o.join(few, F.col("o_orderkey") % 50 == F.col("p_partkey")).select("o_orderkey", "name", F.concat(F.lit("O"), F.col("o_orderkey").cast("string")).alias("own"))
    known = p.where("p_size > 10 AND p_brand <> 'Brand#1'").select(F.concat(F.lit(" "), "p_name", F.lit(" ")).alias("known"), "p_partkey")
    return external_ids(items, "name", "own", known, "known", "p_partkey", "p_partkey").select("o_orderkey", "external_id")


@query("""SELECT c_custkey, coalesce(array_to_string(list_sort(codes), ','), '') AS codes FROM customer LEFT JOIN (SELECT o_custkey, list(DISTINCT o_orderpriority) AS codes FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey) ON o_custkey = c_custkey""")
def collected_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All priorities of a customer's finished orders, none for customers without."""
    codes = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    return with_codes(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", codes, "o_custkey", "o_orderpriority").withColumn("codes", F.array_join("codes", ","))


_CITED = "CASE doc_id % 6 WHEN 0 THEN source || '/download_log' WHEN 1 THEN 'lib/PMC' || (doc_id % 40) || '_a' ELSE source || '/' || doc_id END"


@query(f"""WITH c AS (SELECT source, {_CITED} AS path FROM documents) SELECT source, count(*) AS citations, count(*) FILTER (contains(path, 'download_log')) AS blocklisted,
count(*) FILTER (regexp_matches(path, 'PMC[0-9]+')) > count(DISTINCT nullif(regexp_extract(path, 'PMC[0-9]+'), '')) AS repeated FROM c GROUP BY source""")
def citation_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each source's citations: how many name housekeeping files, and whether a paper is there twice."""
    c = table(spark, sf_dir, "documents").select("source", F.expr(_CITED).alias("path"))
    pmc = F.nullif(F.regexp_extract("path", "PMC[0-9]+", 0), F.lit(""))
    return c.groupBy("source").agg(
        F.count(F.lit(1)).alias("citations"), F.count_if(blocked(F.col("path"), F.col("path"))).alias("blocklisted"), (F.count(pmc) > F.count_distinct(pmc)).alias("repeated")
    )


@query("""SELECT l_orderkey, round(sum(l_quantity), 2) AS parts, floor(max(o_totalprice) / 1000) AS total, abs(floor(max(o_totalprice) / 1000) - round(sum(l_quantity), 2)) <= 1 AS consistent FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY l_orderkey""")
def latency_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a total is the sum of its stages, give or take 1."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.round(F.sum("l_quantity"), 2).alias("parts"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.floor(F.col("o_totalprice") / 1000).cast("double").alias("total"))
    return li.join(o, "l_orderkey").withColumn("consistent", F.abs(F.col("total") - F.col("parts")) <= 1)


@query(r"""WITH e AS (SELECT event_id, round((event_id % 41 - 20) / 8.0::DOUBLE, 2) AS c, CASE WHEN event_id % 5 = 0 THEN 'no date' ELSE '2026-01-' || lpad((1 + event_id % 28)::VARCHAR, 2, '0') END AS a, '2026-' || lpad((2 + event_id % 9)::VARCHAR, 2, '0') || '-15' AS b FROM events),
d AS (SELECT *, try_strptime(a, '%Y-%m-%d')::DATE AS da, try_strptime(b, '%Y-%m-%d')::DATE AS db FROM e)
SELECT event_id, CASE WHEN c < 0 THEN '-' ELSE '+' END || regexp_replace(printf('%.2f', abs(c)), '\.?0+$', '') AS change, CASE WHEN db - da >= 14 THEN round(c / greatest(0.2::DOUBLE, (db - da) / 30.4375::DOUBLE), 4) END AS rate FROM d""")
def signed_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes with their signs, and their rates a month between dates given as texts, of which some are none."""
    i = F.col("event_id")
    pad = lambda c: F.lpad(c.cast("string"), 2, "0")
    change = F.round((i % 41 - 20) / 8.0, 2)
    a = F.when(i % 5 == 0, "no date").otherwise(F.concat(F.lit("2026-01-"), pad(1 + i % 28)))
    b = F.concat(F.lit("2026-"), pad(2 + i % 9), F.lit("-15"))
    return table(spark, sf_dir, "events").select("event_id", signed(change).alias("change"), dated_rate(a, b, change).alias("rate"))
