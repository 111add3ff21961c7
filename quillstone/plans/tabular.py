"""Table queries: rows said as sentences, chunks of documents, measurements in cells, dates and lists in texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators.tabular import SAID, branches, document_chunks, listed_strings, measured, paired, pdf_date, range_bounds, report_date, said_counts, said_tables
from quillstone.plans.catalog import query, table

# Tables as the test data can give them: parts as critical values, suppliers as reference intervals, customers as any table.
CRITICAL = {
    "Test Name": "CASE WHEN p_partkey % 17 = 0 THEN '' ELSE p_name END", "Category": "p_type", "Specimen": "CASE WHEN p_size % 4 = 0 THEN 'nan' ELSE p_brand END",
    "Normal Low": "CASE WHEN p_size % 3 = 0 THEN '' ELSE CAST(p_size AS STRING) END", "Normal High": "CASE WHEN p_size % 5 = 0 THEN 'None' ELSE CAST(p_size + 10 AS STRING) END",
    "Critical Low": "CASE WHEN p_size % 7 < 4 THEN '' ELSE CAST(p_size - 5 AS STRING) END", "Critical High": "CASE WHEN p_size % 2 = 0 THEN 'null' ELSE CAST(p_size + 30 AS STRING) END",
    "Unit": "CASE WHEN p_size % 6 = 0 THEN '' ELSE 'mg/dL' END", "Age Group": "CASE WHEN p_size % 3 = 1 THEN 'adult' ELSE '' END", "Gender": "CASE WHEN p_size % 5 = 1 THEN 'female' ELSE ' ' END",
    "Clinical Interpretation": "CASE WHEN p_size % 4 = 1 THEN 'See ' || p_type ELSE '' END",
}
INTERVALS = {
    "LOINC": "CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE CAST(s_suppkey AS STRING) || '-1' END", "Lab Test": "CASE WHEN s_suppkey % 13 = 0 THEN 'nan' ELSE s_name END", "Specimen": "CASE WHEN s_suppkey % 2 = 0 THEN 'Serum' ELSE '' END",
    "Gender-specific": "CASE WHEN s_suppkey % 5 = 0 THEN 'male' ELSE '' END", "Women-related condition": "''", "Other condition": "CASE WHEN s_suppkey % 7 = 0 THEN 'fasting' ELSE 'none' END",
    "Types of reference range": "CASE WHEN s_suppkey % 4 = 0 THEN 'normal' ELSE '' END", "Traditional Reference Interval": "CASE WHEN s_suppkey % 6 = 0 THEN '' ELSE '1-' || CAST(s_nationkey AS STRING) END",
    "Traditional Units": "CASE WHEN s_suppkey % 8 = 0 THEN '' ELSE 'g/L' END", "SI Reference Interval": "CASE WHEN s_suppkey % 9 = 0 THEN '' ELSE '2-' || CAST(s_nationkey AS STRING) END",
    "SI Units": "CASE WHEN s_suppkey % 10 < 3 THEN 'None' ELSE 'mol/L' END",
}
ANY = {"Name": "c_name", "Unnamed: 1": "'x'", "CID": "'y'", "Segment": "CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_mktsegment END", "Nation": "CASE WHEN c_custkey % 3 = 0 THEN 'nan' ELSE CAST(c_nationkey AS STRING) END"}


def _table(spark: SparkSession, sf_dir: str, name: str, number: int, key: str, cells: dict[str, str]) -> DataFrame:
    """One table of a row for each row of ``name``; every fifth row is ragged: its last two cells are missing."""
    row = F.array(*[F.expr(x) for x in cells.values()])
    row = F.when(F.col(key) % 5 == 4, F.slice(row, 1, len(cells) - 2)).otherwise(row)
    return table(spark, sf_dir, name).select(F.col(key).alias("doc_id"), F.lit(number).alias("table"), F.array(*map(F.lit, cells)).alias("headers"), F.array(row).alias("rows"))


def _tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = [("part", "p_partkey", CRITICAL), ("supplier", "s_suppkey", INTERVALS), ("customer", "c_custkey", ANY)]
    a, b, c = (_table(spark, sf_dir, t, i, k, x) for i, (t, k, x) in enumerate(found))
    return a.unionByName(b).unionByName(c)


def _clean(key: str, cells: dict[str, str]) -> str:
    """The cells in SQL: null where they say nothing or a ragged row has none."""
    out = []
    for i, (h, x) in enumerate(cells.items()):
        value = f"CASE WHEN lower(trim({x})) IN ('nan', 'none', 'null', '') THEN NULL ELSE trim({x}) END"
        ragged = f"CASE WHEN {key} % 5 = 4 THEN NULL ELSE {value} END" if i >= len(cells) - 2 else value
        out.append(f'{ragged} AS "{h}"')
    return f"{key} AS doc_id, " + ", ".join(out)


_IN = "coalesce(' (' || nullif(concat_ws(', ', {}), '') || ')', '')"
_SAID_SQL = f"""critical AS (SELECT doc_id, 0 AS "table", "Test Name" || {_IN.format('"Category", "Specimen"')} || ': ' || concat_ws('; ', b, 'for ' || nullif(concat_ws(', ', "Age Group", "Gender"), '')) || '.' || coalesce(' ' || "Clinical Interpretation", '') AS text FROM (
  SELECT *, nullif(concat_ws('; ', CASE WHEN "Normal Low" IS NOT NULL AND "Normal High" IS NOT NULL THEN 'normal range ' || "Normal Low" || '–' || concat_ws(' ', "Normal High", "Unit")
    WHEN "Normal Low" IS NOT NULL THEN 'normal low ' || concat_ws(' ', "Normal Low", "Unit") WHEN "Normal High" IS NOT NULL THEN 'normal high ' || concat_ws(' ', "Normal High", "Unit") END,
    'critical low ' || "Critical Low" || coalesce(' ' || "Unit", ''), 'critical high ' || "Critical High" || coalesce(' ' || "Unit", '')), '') AS b
  FROM (SELECT {_clean("p_partkey", CRITICAL)} FROM part)) WHERE b IS NOT NULL AND "Test Name" IS NOT NULL),
intervals AS (SELECT doc_id, 1 AS "table", "Lab Test" || coalesce(' (LOINC: ' || "LOINC" || ')', '') || {_IN.format('"Specimen", "Gender-specific", coalesce("Women-related condition", "Other condition")')} || ': ' || b || '.' AS text FROM (
  SELECT *, nullif(concat_ws('; ', 'reference type: ' || "Types of reference range", 'reference interval ' || "Traditional Reference Interval" || coalesce(' ' || "Traditional Units", ''), 'SI interval ' || "SI Reference Interval" || ' ' || "SI Units"), '') AS b
  FROM (SELECT {_clean("s_suppkey", INTERVALS)} FROM supplier)) WHERE b IS NOT NULL AND "Lab Test" IS NOT NULL),
other AS (SELECT doc_id, 2 AS "table", concat_ws('; ', 'Name: ' || "Name", 'Segment: ' || "Segment", 'Nation: ' || "Nation") || '.' AS text FROM (SELECT {_clean("c_custkey", ANY)} FROM customer)
  WHERE ("Segment" IS NOT NULL)::INT + ("Nation" IS NOT NULL)::INT >= 1),
said AS (SELECT * FROM critical UNION ALL SELECT * FROM intervals UNION ALL SELECT * FROM other)"""


@query(rf"""WITH {_SAID_SQL} SELECT doc_id, "table", text, greatest(1, floor(len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) * 1.3::DOUBLE))::INT AS tokens FROM said""")
def said_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of three kinds of tables as sentences; the kind follows from the headers."""
    return said_tables(_tables(spark, sf_dir)).where("text is not null").select("doc_id", "table", "text", "tokens")


@query(f"""WITH {_SAID_SQL}, n AS (SELECT p_partkey AS doc_id, 0 AS "table" FROM part UNION ALL SELECT s_suppkey, 1 FROM supplier UNION ALL SELECT c_custkey, 2 FROM customer)
SELECT n."table", count(text) AS chunks, count(*) - count(text) AS skipped FROM n LEFT JOIN said ON n.doc_id = said.doc_id AND n."table" = said."table" GROUP BY 1""")
def said_row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows of each table became sentences, and how many say too little."""
    per = said_counts(said_tables(_tables(spark, sf_dir)))
    return per.groupBy("table").agg(F.sum("chunks").alias("chunks"), F.sum("skipped").alias("skipped"))


_CATEGORY = "CASE doc_id % 8 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(SAID)) + " ELSE 'ontology' END"


def _documents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents with abstracts and figures here and there, and a table each second one has of its own columns."""
    d = table(spark, sf_dir, "documents")
    figure = F.struct(F.concat(F.lit(" figure of "), F.col("source")).alias("ocr_text"), (F.col("doc_id") % 9).cast("int").alias("page_number"))
    blank = F.struct(F.lit(" ").alias("ocr_text"), F.lit(1).alias("page_number"))
    docs = d.select(
        "doc_id", F.expr(_CATEGORY).alias("category"), F.when(F.col("doc_id") % 3 == 0, F.substring("text", 1, 60)).alias("abstract"), F.col("text").alias("body"),
        F.when(F.col("doc_id") % 5 == 0, F.array(blank, figure)).otherwise(F.array().cast("array<struct<ocr_text:string,page_number:int>>")).alias("figures"),
    )
    headers = F.array(*map(F.lit, ["Language", "Source", "Characters"]))
    some = d.where("doc_id % 2 = 0").select("doc_id", F.lit(0).alias("table"), headers.alias("headers"), F.array(F.array("lang", "source", F.col("n_chars").cast("string"))).alias("rows"))
    return docs, some


_SIZE = r"greatest(1, floor(len(list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '')) * 1.3::DOUBLE))"


@query(f"""SELECT doc_id, category, said, trim(coalesce(text, ''), ' ') <> '' AND NOT (said > 0 AND category = 'lab_reference' AND {_SIZE} > 800) AS chunk_body
FROM (SELECT doc_id, text, {_CATEGORY} AS category, CASE WHEN doc_id % 2 = 0 AND {_CATEGORY} <> 'ontology' THEN 1 ELSE 0 END AS said FROM documents)""")
def chunk_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of each document becomes chunks: how many table rows, and whether its body does."""
    return branches(*_documents(spark, sf_dir)).select("doc_id", "category", F.col("said").cast("int").alias("said"), "chunk_body")


@query()
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chunks of all documents, with their documents' category."""
    return document_chunks(*_documents(spark, sf_dir), keep=["category"])


# Lines of orders as report rows: a name, a flag, a number, a unit and a range; some are headers, some without a number.
_CELLS = [
    "CASE WHEN l_linenumber % 7 = 6 THEN 'Test Name' WHEN l_linenumber % 7 = 5 THEN 'x' ELSE 'Analyte ' || CAST(l_partkey % 50 AS STRING) END",
    "CASE WHEN l_partkey % 4 = 0 THEN CAST(CAST(l_quantity AS INT) AS STRING) WHEN l_partkey % 4 = 1 THEN 'n/a' ELSE l_returnflag END",
    "CASE WHEN l_partkey % 3 = 0 THEN '>' || CAST(l_linenumber AS STRING) ELSE ' ' || CAST(CAST(l_quantity AS INT) AS STRING) || '.5 ' END", "l_linestatus || '/L'",
    "CASE WHEN l_suppkey % 3 = 0 THEN '1.5 - 30' WHEN l_suppkey % 3 = 1 THEN '<40' ELSE 'see note' END",
]


@query(rf"""WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, [{", ".join(_CELLS)}] AS c FROM lineitem),
f AS (SELECT *, list_position(list_transform(c[2:], lambda x: regexp_matches(trim(x), '^[+-]?[0-9]+(\.[0-9]+)?$')), true) AS pos FROM r),
v AS (SELECT l_orderkey, l_linenumber, l_partkey, trim(c[1]) AS test_name, trim(c[pos + 1]) AS value_text, trim(coalesce(c[pos + 2], '')) AS unit, trim(coalesce(c[pos + 3], '')) AS range FROM f WHERE pos > 0 AND length(trim(c[1])) >= 2 AND lower(c[1]) NOT LIKE '%test name%'),
b AS (SELECT *, regexp_extract_all(range, '[0-9]+\.?[0-9]*') AS n FROM v)
SELECT l_orderkey, l_linenumber, l_partkey, test_name, value_text::DOUBLE AS value, unit, range, CASE WHEN len(n) >= 2 THEN n[1]::DOUBLE ELSE 0.0::DOUBLE END AS low,
CASE WHEN len(n) >= 2 THEN n[2]::DOUBLE WHEN len(n) = 1 THEN n[1]::DOUBLE ELSE 9999.0::DOUBLE END AS high FROM b""")
def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements in table rows: the first number after the name, the unit and range beside it, the range's bounds."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.array(*[F.expr(x) for x in _CELLS]).alias("cells"))
    found = measured(rows).withColumn("b", range_bounds(F.col("range")))
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "test_name", "value", "unit", "range", "b.low", "b.high")


_DAY = "substr(CAST(o_orderdate AS STRING), 1, 10)"
_NOTE = f"CASE o_orderkey % 5 WHEN 0 THEN 'Report date: ' || {_DAY} || ' of 2001-01-01' WHEN 1 THEN 'seen 1999-12-31, Date 2000-02-' || CAST(10 + o_orderkey % 10 AS STRING) WHEN 2 THEN 'on ' || {_DAY} ELSE 'no day' END"
_STAMP = f"CASE WHEN o_orderkey % 3 = 0 THEN 'D:' || replace({_DAY}, '-', '') || '000000Z' WHEN o_orderkey % 3 = 1 THEN ' ' || {_DAY} ELSE '' END"


@query(f"""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN {_DAY} WHEN 1 THEN '2000-02-' || (10 + o_orderkey % 10) WHEN 2 THEN {_DAY} ELSE '1970-01-01' END AS report_date,
CASE WHEN o_orderkey % 3 < 2 THEN {_DAY} END AS made FROM orders""")
def text_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates named in reports' texts, and dates as PDF files hold them."""
    return table(spark, sf_dir, "orders").select("o_orderkey", report_date(F.expr(_NOTE), F.lit("1970-01-01")).alias("report_date"), pdf_date(F.expr(_STAMP)).alias("made"))


_ASKED = "concat('What is line ', CAST(l_linenumber AS STRING), '?')"


@query(f"SELECT l_orderkey, l_linenumber, CASE l_orderkey % 4 WHEN 3 THEN '' WHEN 2 THEN {_ASKED} || '|How much is it now?' ELSE {_ASKED} END AS asked FROM lineitem")
def sub_question_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists in replies that may be JSON, hold a block of it, or only quote its strings."""
    asked, k = F.expr(_ASKED), F.col("l_orderkey") % 4
    whole = F.format_string('{"sub_questions": ["%s", " "]}', asked)
    block = F.format_string('Sure:\n```json\n{"sub_questions": ["%s"]}\n```', asked)
    quoted = F.format_string('I ask "%s" and "How much is it now?"', asked)
    reply = F.when(k == 0, whole).when(k == 1, block).when(k == 2, quoted).otherwise("nothing here")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(listed_strings(reply), "|").alias("asked"))


@query("SELECT p_partkey, 'P' || p_partkey AS id, p_name AS name FROM part UNION ALL SELECT p_partkey, 'B' || p_partkey, p_brand FROM part")
def printed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifier and name pairs out of a structure's printed form."""
    k = F.col("p_partkey")
    text = F.format_string("[{'id': 'P%d', 'x': 1, 'name': '%s'}, {'id': 'B%d', 'name': '%s'}]", k, F.col("p_name"), k, F.col("p_brand"))
    p = table(spark, sf_dir, "part").select("p_partkey", paired(text, r"'id': *'([A-Z0-9]+)'.*?'name': *'([^']+)'", ("id", "name")).alias("x"))
    return p.select("p_partkey", F.inline("x"))
