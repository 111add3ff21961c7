"""Queries of what is shown or stored: test and chunk nodes, batches, citations by kind, default ranges, whole reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators.lab import RANGES
from quillstone.operators.projections import ESCALATION, SHOWN_RANGES, batches, chunk_nodes, citations_of, interpreted, test_nodes, with_default_ranges
from quillstone.plans.catalog import query, table
from quillstone.plans.clinical import measurements
from quillstone.plans.tabular import CRITICAL, _clean, _table

# Suppliers as a table of tests with other headers.
COMPONENTS = {
    "Component Name": "CASE WHEN s_suppkey % 11 = 0 THEN 'none' ELSE s_name END",
    "System": "CASE WHEN s_suppkey % 2 = 0 THEN 'Serum' ELSE '' END",
    "Category of Lab Test": "'group ' || CAST(s_nationkey AS STRING)",
    "Traditional Units": "CASE WHEN s_suppkey % 8 = 0 THEN '' ELSE 'g/L' END",
}
_OR = lambda name: f"""coalesce("{name}", '')"""
_KEY = "substr(md5(concat_ws('||', test_name, specimen, age_group, gender, source_doc)), 1, 16) AS lab_test_id"


@query(f"""WITH a AS (SELECT 'tests/critical' AS source_doc, {_OR("Test Name")} AS test_name, {_OR("Category")} AS category, {_OR("Specimen")} AS specimen,
"Normal Low"::DOUBLE AS normal_low, "Normal High"::DOUBLE AS normal_high, {_OR("Critical Low")} AS critical_low, {_OR("Critical High")} AS critical_high,
{_OR("Unit")} AS unit, {_OR("Age Group")} AS age_group, {_OR("Gender")} AS gender FROM (SELECT {_clean("p_partkey", CRITICAL)} FROM part)),
b AS (SELECT 'tests/components' AS source_doc, {_OR("Component Name")} AS test_name, {_OR("Category of Lab Test")} AS category, {_OR("System")} AS specimen,
NULL::DOUBLE AS normal_low, NULL::DOUBLE AS normal_high, '' AS critical_low, '' AS critical_high, {_OR("Traditional Units")} AS unit, '' AS age_group, '' AS gender
FROM (SELECT {_clean("s_suppkey", COMPONENTS)} FROM supplier))
SELECT *, {_KEY} FROM (SELECT * FROM a UNION ALL SELECT * FROM b) WHERE test_name <> ''""")
def lab_test_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the tests that two tables name under different headers."""
    a = _table(spark, sf_dir, "part", 0, "p_partkey", CRITICAL).withColumn("source_doc", F.lit("tests/critical"))
    b = _table(spark, sf_dir, "supplier", 1, "s_suppkey", COMPONENTS).withColumn("source_doc", F.lit("tests/components"))
    return test_nodes(a.unionByName(b).select("source_doc", "headers", F.explode("rows").alias("cells")))


@query("""SELECT 'o' || l_orderkey AS document_id, 'o' || l_orderkey || '__c' || l_linenumber AS chunk_id, l_returnflag AS chunk_type, l_quantity::INT AS token_count,
l_orderkey * 8 + l_linenumber AS faiss_id, o_orderpriority AS category, o_orderstatus AS language, 'o' || l_orderkey AS source_doc FROM lineitem JOIN orders ON o_orderkey = l_orderkey""")
def chunk_node_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' lines as chunks with the metadata of their orders."""
    document = lambda c: F.concat(F.lit("o"), F.col(c).cast("string")).alias("document_id")
    chunk = F.concat(F.lit("o"), F.col("l_orderkey").cast("string"), F.lit("__c"), F.col("l_linenumber").cast("string"))
    lines = table(spark, sf_dir, "lineitem").select(
        document("l_orderkey"), chunk.alias("chunk_id"), F.col("l_returnflag").alias("chunk_type"), F.col("l_quantity").alias("token_count"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("faiss_id")
    )
    orders = table(spark, sf_dir, "orders").select(document("o_orderkey"), F.col("o_orderpriority").alias("category"), F.col("o_orderstatus").alias("language"))
    return chunk_nodes(lines, orders)


@query("SELECT (event_id - 7) // 64 AS batch, count(*) AS n, min(event_id) AS first, max(event_id) AS last FROM events WHERE event_id >= 7 GROUP BY batch")
def index_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of 64 of the rows from the seventh on, as a run resumes from it."""
    found = batches(table(spark, sf_dir, "events"), "event_id", 7, 64)
    return found.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"), F.max("event_id").alias("last"))


_CATEGORY = "CASE event_type WHEN 'click' THEN 'Clinical Guideline' WHEN 'view' THEN 'PubMed drug paper' WHEN 'purchase' THEN 'Medication' WHEN 'signup' THEN 'private_report' END"


@query(f"""WITH c AS (SELECT user_id, event_id, value, lower(coalesce({_CATEGORY}, '')) AS c FROM events),
s AS (SELECT 'all' AS shown, * FROM c UNION ALL SELECT 'guideline', * FROM c WHERE contains(c, 'guideline') UNION ALL SELECT 'drug', * FROM c WHERE contains(c, 'drug') OR contains(c, 'medication')
UNION ALL SELECT 'research_paper', * FROM c WHERE contains(c, 'research') OR contains(c, 'paper') OR contains(c, 'pubmed') UNION ALL SELECT 'private_report', * FROM c WHERE contains(c, 'private') OR contains(c, 'report'))
SELECT shown, user_id, event_id, row_number() OVER (PARTITION BY user_id, shown ORDER BY value DESC, event_id) AS rank FROM s""")
def shown_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' events as citations of several categories: what each choice of a kind shows, best first."""
    return citations_of(table(spark, sf_dir, "events").withColumn("category", F.expr(_CATEGORY)), "user_id", "category", "value", "event_id")


_KNOWN = ", ".join(f"('{n}', {low}::DOUBLE, {high}::DOUBLE)" for n, low, high, *_ in RANGES)
_NAME = "CASE event_type WHEN 'click' THEN 'Creatinine' WHEN 'view' THEN 'Hemoglobin A1c' WHEN 'purchase' THEN 'Potassium' WHEN 'signup' THEN 'Glucose' ELSE 'Ferritin' END"


_SHOWN = "CASE event_type WHEN 'click' THEN 'Creatinine, serum' WHEN 'view' THEN 'Hemoglobin A1C' WHEN 'purchase' THEN 'POTASSIUM' WHEN 'signup' THEN 'eGFR (MDRD)' ELSE 'Ferritin' END"
_PARTS = [f"WHEN contains(lower(name), '{part}') THEN {{{i}}}" for i, (part, *_) in enumerate(SHOWN_RANGES)]
_LOWS, _HIGHS = ("CASE " + " ".join(_PARTS).format(*[f"{r[i]}::DOUBLE" for r in SHOWN_RANGES]) + " ELSE {} END" for i in (1, 2))


@query(f"""WITH m AS (SELECT event_id, {_SHOWN} AS name, CASE WHEN event_id % 3 = 0 THEN 20.0::DOUBLE END AS low, CASE WHEN event_id % 5 = 0 THEN 80.0::DOUBLE END AS high FROM events)
SELECT event_id, CASE WHEN low IS NULL OR high IS NULL THEN {_LOWS.format("low")} ELSE low END AS ref_low, CASE WHEN low IS NULL OR high IS NULL THEN {_HIGHS.format("high")} ELSE high END AS ref_high FROM m""")
def default_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements with the bounds that some reports leave out."""
    own = {"ref_low": F.when(F.col("event_id") % 3 == 0, 20.0), "ref_high": F.when(F.col("event_id") % 5 == 0, 80.0)}
    m = table(spark, sf_dir, "events").select("event_id", F.expr(_SHOWN).alias("test_name")).withColumns(own)
    return with_default_ranges(m).select("event_id", "ref_low", "ref_high")


_FACTOR = "CASE event_type WHEN 'click' THEN 88.4::DOUBLE WHEN 'signup' THEN 0.0555::DOUBLE ELSE 1.0::DOUBLE END"
_BOUNDS = ", ".join(f"('{n}', {low}::DOUBLE, {high}::DOUBLE, {c or 'NULL'}::DOUBLE, {d}::DOUBLE)" for n, low, high, c, d in RANGES)


@query(f"""WITH m AS (SELECT user_id, ts::DATE AS day, event_id, {_NAME} AS name, round(value * {_FACTOR}, 4) AS v, event_type || '-table' AS source FROM events),
a AS (SELECT m.*, coalesce(v <= c_low OR v >= c_high, false) OR coalesce(v <= c_low, false) OR coalesce(v >= c_high, false) AS critical FROM m LEFT JOIN (VALUES {_BOUNDS}) r(name, low, high, c_low, c_high) USING (name)),
s AS (SELECT user_id, day, string_agg(source, ',' ORDER BY first) AS provenance FROM (SELECT user_id, day, source, min(event_id) AS first FROM m GROUP BY ALL) GROUP BY ALL)
SELECT user_id, day, count(*) AS values, bool_or(critical) AS critical, 'Parsed CSV report (' || count(*) || ' lab values extracted).' AS summary,
CASE WHEN bool_or(critical) THEN '{ESCALATION}' END AS escalation, any_value(provenance) AS provenance FROM a JOIN s USING (user_id, day) GROUP BY user_id, day""")
def interpreted_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's measurements of a day as one report, from units to its summary."""
    ranges = spark.createDataFrame(RANGES, "canonical string, low double, high double, critical_low double, critical_high double")
    m = measurements(spark, sf_dir).withColumns({
        "source": F.concat("event_type", F.lit("-table")), "format": F.lit("csv"), "ref_low": F.lit(None).cast("double"), "ref_high": F.lit(None).cast("double"),
    })
    return interpreted(spark, m, F.broadcast(ranges), ["user_id", "day"], "event_id", "source", "format")
