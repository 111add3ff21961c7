"""Queries around answers: sub-questions, coverage, retries, final texts, reports, statistics of traversals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators.answering import (
    DISCLAIMER, OUT_OF_SCOPE_ANSWER, final_answers, graph_statistics, path_edges, report_texts, retry_mode, sub_questions, trajectories,
)
from quillstone.operators.verification import OUT_OF_SCOPE, qa_metrics, routed
from quillstone.plans.answers import _has
from quillstone.plans.catalog import SQL, query, table
from quillstone.plans.clinical import _ASSESSED, _TEST, _UNIT, _classes, caregap_missing, caregap_out_of_target
from quillstone.plans.retrieval import _FUSED, _fused

_ONCE = r"regexp_replace({}, '(^|[^\p{{L}}\p{{N}}_])(and|with|for)($|[^\p{{L}}\p{{N}}_])', '\1,\3', 'gi')"
_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


@query(rf"""WITH q AS (SELECT conv_id, turn, {_STRIP.format("text")} AS q FROM conversations WHERE role = 'user'),
c AS (SELECT *, list_filter(list_transform(regexp_split_to_array({_ONCE.format(_ONCE.format("q"))}, ',|;'), lambda c: {_STRIP.format("c")}), lambda c: length(c) > 3) AS c FROM q)
SELECT conv_id, turn, CASE WHEN len(c) >= 2 THEN 'What are the clinical guidelines and mechanisms regarding ' || c[1] || '?' ELSE 'What is the clinical definition and diagnostic criteria for ' || q || '?' END AS first,
CASE WHEN len(c) >= 2 THEN 'How does ' || c[2] || ' affect clinical outcomes and management?' ELSE 'What are the evidence-based management and monitoring recommendations for ' || q || '?' END AS second FROM c""")
def question_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's turn as two sub-questions."""
    c = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", sub_questions(F.col("text")).alias("s"))
    return c.select("conv_id", "turn", F.get("s", F.lit(0)).alias("first"), F.get("s", F.lit(1)).alias("second"))


@query(f"""WITH m AS ({SQL["caregap_missing"]}), o AS ({SQL["caregap_out_of_target"]}), a AS (SELECT user_id, count(*) AS missing, 0 AS outside FROM m GROUP BY user_id UNION ALL SELECT user_id, 0, count(*) FROM o GROUP BY user_id),
s AS (SELECT user_id, sum(missing)::BIGINT AS missing, sum(outside)::BIGINT AS outside FROM a GROUP BY user_id)
SELECT user_id, missing, outside, 'Identified ' || (missing + outside) || ' item(s):' || CASE WHEN outside > 0 THEN chr(10) || ' - ' || outside || ' value(s) outside targets.' ELSE '' END || CASE WHEN missing > 0 THEN chr(10) || ' - ' || missing || ' check(s) not observed.' ELSE '' END AS summary FROM s""")
def gap_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many checks each user misses and how many values lie outside their goals, in words."""
    kinds = caregap_missing(spark, sf_dir).select("user_id", F.lit("missing").alias("kind")).unionByName(caregap_out_of_target(spark, sf_dir).select("user_id", F.lit("outside").alias("kind")))
    n = kinds.groupBy("user_id").agg(F.count_if(F.col("kind") == "missing").alias("missing"), F.count_if(F.col("kind") == "outside").alias("outside"))
    line = lambda c, text: F.when(F.col(c) > 0, F.concat(F.lit("\n - "), F.col(c).cast("string"), F.lit(text))).otherwise("")
    said = F.concat(F.lit("Identified "), (F.col("missing") + F.col("outside")).cast("string"), F.lit(" item(s):"), line("outside", " value(s) outside targets."), line("missing", " check(s) not observed."))
    return n.withColumn("summary", said)


@query(f"""WITH {_FUSED} SELECT f.query_id, array_to_string(list_sort(list(DISTINCT d.lang)), ',') AS edges, count(DISTINCT d.source) AS entities, count(*) FILTER (found_by = 'graph') AS from_graph
FROM fused f JOIN documents d ON d.doc_id = f.item_id GROUP BY f.query_id""")
def traversal_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each query: kinds of edges, entities reached and hits that only the graph found (languages as kinds, sources as entities)."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), "lang", "source")
    return graph_statistics(_fused(spark, sf_dir).join(d, "item_id"), "query_id", "lang", "source", "found_by")


@query(f"""WITH {_FUSED} SELECT query_id, item_id, CASE WHEN graph_rank IS NOT NULL THEN CASE WHEN d.lang = 'fr' THEN 0.35::DOUBLE ELSE 0.7::DOUBLE END ELSE 0.5::DOUBLE END AS graph_score FROM fused JOIN documents d ON d.doc_id = item_id""")
def graph_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph's own score of each hit, half for edges of low trust; the fused score doesn't change by it."""
    from quillstone.operators.fusion import trusted_score

    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.when(F.col("lang") == "fr", "low").when(F.col("lang") == "en", "high").otherwise("medium").alias("trust"))
    fused = _fused(spark, sf_dir).join(d, "item_id")
    return fused.select("query_id", "item_id", trusted_score(F.col("graph_score"), F.when(F.col("graph_rank").isNotNull(), F.col("trust"))).alias("graph_score"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity / 10 >= 3.5 OR l_linenumber > 2 THEN 'none' WHEN l_discount * 10 < 0.5 THEN 'more_evidence' WHEN l_tax * 10 < 0.5 THEN 'strict_prompt' ELSE 'none' END AS mode,
CASE WHEN l_quantity / 10 >= 3.5 OR l_linenumber > 2 THEN NULL WHEN l_discount * 10 < 0.5 THEN floor(10 * (1 + 0.5 * l_linenumber))::INT WHEN l_tax * 10 < 0.5 THEN 10 END AS top_n FROM lineitem""")
def retry_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How an answer with some evidence, faithfulness, tries and seconds is tried again."""
    li = table(spark, sf_dir, "lineitem")
    m = retry_mode(F.col("l_discount") * 10, F.col("l_tax") * 10, F.col("l_linenumber"), F.col("l_quantity") / 10)
    return li.select("l_orderkey", "l_linenumber", "l_partkey", m.alias("m")).select("l_orderkey", "l_linenumber", "l_partkey", "m.mode", "m.top_n")


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, round(max(l_quantity) / 50, 2) AS c FROM lineitem GROUP BY ALL),
n AS (SELECT l_orderkey, c, row_number() OVER w AS n, lag(c) OVER w AS p FROM c WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) QUALIFY n <= 3),
s AS (SELECT *, coalesce(abs(c - p) < 0.05, false) AS stop FROM n), r AS (SELECT *, coalesce(bool_or(stop) OVER (PARTITION BY l_orderkey ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS before FROM s)
SELECT l_orderkey, count(*) AS tries, max(c) AS best, arg_min(n, (-c, n)) AS best_attempt, string_agg(c::DECIMAL(10, 2)::VARCHAR, ' ' ORDER BY n) AS path FROM r WHERE NOT before GROUP BY l_orderkey""")
def retry_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's lines as tries of one answer, until confidence stands still."""
    c = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(F.round(F.max("l_quantity") / 50, 2).alias("c"))
    return trajectories(c.withColumn("try", F.struct("l_linenumber", "l_partkey")), "l_orderkey", "try", "c")


_FIXED = OUT_OF_SCOPE_ANSWER.replace("'", "''").replace("\n", "' || chr(10) || '")
_END = DISCLAIMER.replace("'", "''")


@query(rf"""WITH r AS (SELECT conv_id, turn, {_has(OUT_OF_SCOPE)} AS off, (turn % 10) / 10.0::DOUBLE AS confidence, {_STRIP.format(f"CASE WHEN turn % 3 = 0 THEN text || chr(10) || upper('{_END}') ELSE text END")} AS text FROM conversations)
SELECT conv_id, turn, CASE WHEN off THEN '{_FIXED}' WHEN turn % 3 = 0 THEN text ELSE text || chr(10) || chr(10) || '{_END}' END AS answer, CASE WHEN off THEN 'out_of_scope' ELSE 'verified' END AS status,
CASE WHEN off THEN 1.0::DOUBLE ELSE confidence END AS final_confidence, CASE WHEN off OR confidence >= 0.7 THEN 'high' WHEN confidence >= 0.5 THEN 'medium' ELSE 'low' END AS tier FROM r""")
def composed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as generated answers: with the disclaimer at the end, fixed ones to questions out of scope, and the tier without verification."""
    c = table(spark, sf_dir, "conversations")
    said = F.when(F.col("turn") % 3 == 0, F.concat("text", F.lit("\n" + DISCLAIMER.upper()))).otherwise(F.col("text"))
    c = c.select("conv_id", "turn", routed(F.col("text"), F.lit(False)).alias("route"), said.alias("said"), (F.col("turn") % 10 / 10.0).alias("confidence"))
    return final_answers(c, "route", "said", "confidence").select("conv_id", "turn", "answer", "status", "final_confidence", "tier")


_SIGN = "CASE WHEN class LIKE 'critical%' THEN '⚠️' WHEN class IN ('low', 'high') THEN '🔴' ELSE '🟢' END"


@query(f"""WITH a AS (SELECT e.user_id, e.ts::DATE AS day, e.event_id, {_TEST.replace("event_type", "e.event_type")} AS name, {_UNIT.replace("event_type", "e.event_type")} AS unit, floor(e.value)::INT AS value, a.class FROM events e JOIN ({_ASSESSED}) a USING (event_id)),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY event_id) AS n FROM a)
SELECT user_id, day, bool_or(class LIKE 'critical%') AS critical, CASE WHEN bool_or(class LIKE 'critical%') THEN 'Critical values: seek care now.' || chr(10) || chr(10) ELSE '' END
|| string_agg(n || '. ' || {_SIGN} || ' **' || name || '**: `' || value || ' ' || unit || '` (' || upper(class) || ')' || chr(10) || '   - It is ' || class, chr(10) ORDER BY n) || chr(10) || '{_END}' AS text FROM n GROUP BY user_id, day""")
def rendered_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's measurements of a day as a report's text."""
    m = _classes(spark, sf_dir).withColumn("shown", F.floor("value").cast("int")).withColumn("means", F.concat(F.lit("It is "), "class"))
    return report_texts(m, ["user_id", "day"], ["event_id"], "test_name", "shown", "unit", "class", "means")


@query("""WITH a AS (SELECT l_returnflag, l_partkey % 7 > 1 AS a, (l_suppkey - l_orderkey) % 4 AS g, l_partkey % 5 = 0 AS h FROM lineitem)
SELECT l_returnflag, count(*) AS n, round(100.0::DOUBLE * count(*) FILTER (a AND g = 0) / count(*), 2) AS accuracy, round(100.0::DOUBLE * count(*) FILTER (a AND g = 0) / nullif(count(*) FILTER (a), 0), 2) AS accuracy_answered,
round(100.0::DOUBLE * count(*) FILTER (a) / count(*), 2) AS answered, round(100.0::DOUBLE * count(*) FILTER (NOT a) / count(*), 2) AS refused, round(100.0::DOUBLE * count(*) FILTER (a AND g <> 0) / count(*), 2) AS wrong,
round(100.0::DOUBLE * count(*) FILTER (a AND h) / count(*), 2) AS hedged, round(round(100.0::DOUBLE * count(*) FILTER (a AND h) / count(*), 2) / 100 * count(*))::BIGINT AS hedged_answers FROM a GROUP BY l_returnflag""")
def hedged_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's rates with that of hedging answers, and the count that a rate stands for."""
    letter = lambda c: F.char((65 + F.col(c) % 4).cast("int"))
    given = F.when(F.col("l_partkey") % 7 > 1, letter("l_suppkey"))
    said = F.when(F.col("l_partkey") % 5 == 0, "The evidence does not say").otherwise("It is so")
    m = qa_metrics(table(spark, sf_dir, "lineitem").select("l_returnflag", letter("l_orderkey").alias("gold"), given.alias("given"), said.alias("said")), ["l_returnflag"], "gold", "given", "said")
    return m.withColumn("hedged_answers", F.round(F.col("hedged") / 100 * F.col("n")).cast("long"))


_SAMPLE = 50


@query(f"""WITH q AS (SELECT o_orderkey AS id, md5(o_orderkey || ':42') AS place, [o_orderstatus, o_orderpriority, 'x' || o_custkey, 'none'] AS options, CASE WHEN o_orderkey % 3 = 0 THEN 'B' WHEN o_orderkey % 3 = 1 THEN 'x' || o_custkey ELSE 'unknown' END AS answer FROM orders)
SELECT id, CASE WHEN answer IN ('A', 'B', 'C', 'D') THEN answer ELSE chr((64 + list_position(options, answer))::INT) END AS gold FROM q ORDER BY place, id LIMIT {_SAMPLE}""")
def benchmark_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seeded sample of questions (a sampling operator), with the letter of the right option, by itself or by the option's text."""
    k = F.col("o_orderkey")
    options = F.array("o_orderstatus", "o_orderpriority", F.concat(F.lit("x"), F.col("o_custkey").cast("string")), F.lit("none"))
    answer = F.when(k % 3 == 0, "B").when(k % 3 == 1, F.concat(F.lit("x"), F.col("o_custkey").cast("string"))).otherwise("unknown")
    q = table(spark, sf_dir, "orders").select(k.alias("id"), F.md5(F.concat(k.cast("string"), F.lit(":42"))).alias("place"), options.alias("options"), answer.alias("answer"))
    at = F.array_position("options", F.col("answer"))
    gold = F.when(F.col("answer").isin("A", "B", "C", "D"), F.col("answer")).when(at > 0, F.char((64 + at).cast("int")))
    return q.select("id", "place", gold.alias("gold")).orderBy("place", "id").limit(_SAMPLE).select("id", "gold")


@query("""WITH p AS (SELECT l_orderkey AS id, l_linenumber AS n, l_partkey, 'P' || l_partkey || ' -[MENTIONS]-> D' || l_orderkey || CASE WHEN l_linenumber % 2 = 0 THEN ' -[SOLD_BY]-> S' || l_suppkey ELSE '' END AS path,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS r, l_suppkey FROM lineitem QUALIFY r <= 3)
SELECT id, 'P' || l_partkey AS src, 'MENTIONS' AS edge, 'D' || id AS dst, count(*) AS n FROM p GROUP BY ALL UNION ALL SELECT id, 'D' || id, 'SOLD_BY', 'S' || l_suppkey, count(*) FROM p WHERE path LIKE '%SOLD_BY%' GROUP BY ALL""")
def shown_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the first three paths of each order, as a picture of them needs."""
    text = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    path = F.concat(text("P", "l_partkey"), F.lit(" -[MENTIONS]-> "), text("D", "l_orderkey"), F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit(" -[SOLD_BY]-> "), text("S", "l_suppkey"))).otherwise(""))
    p = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("o"), path.alias("path"))
    return path_edges(p, "id", "o", "path")
