"""Answer checks: routing, claims, faithfulness, confidence, benchmark metrics, medians."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators.verification import (
    ASIDES, MEDICAL, OUT_OF_SCOPE, RELATIONAL, answer_status, choice, faithfulness, final_confidence, labelled_claims, mechanism, needs_retry, qa_metrics, routed, tier,
    upper_median, verdict,
)
from quillstone.plans.catalog import query, table


def _has(words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower(text), '{w}')" for w in words) + ")"


@query(f"SELECT conv_id, turn, CASE WHEN turn = 0 AND conv_id % 10 = 0 THEN 'report' WHEN {_has(OUT_OF_SCOPE)} THEN 'out_of_scope' WHEN {_has(RELATIONAL)} THEN 'knowledge_graph' ELSE 'medical_query' END AS route FROM conversations WHERE role = 'user'")
def route_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").where("role = 'user'")
    return c.select("conv_id", "turn", routed(F.col("text"), (F.col("turn") == 0) & (F.col("conv_id") % 10 == 0)).alias("route"))


@query(f"""SELECT conv_id, turn, CASE WHEN (turn = 0 AND conv_id % 10 = 0) OR {_has(OUT_OF_SCOPE)} OR {_has(RELATIONAL)} OR {_has(MEDICAL)} THEN 'rule_first' ELSE 'rule_default' END AS mechanism FROM conversations WHERE role = 'user'""")
def route_mechanisms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a rule decided a turn's route."""
    c = table(spark, sf_dir, "conversations").where("role = 'user'")
    return c.select("conv_id", "turn", mechanism(F.col("text"), (F.col("turn") == 0) & (F.col("conv_id") % 10 == 0)).alias("mechanism"))


_CITED = "['[E1]', '[E' || (1 + turn % 3) || ']']"
_ASIDE = " OR ".join(f"contains(lower(s), '{p}')" for p in ASIDES)


@query(rf"""WITH a AS (SELECT conv_id, turn, {_CITED} AS cited, CASE WHEN turn % 4 = 1 THEN text || ' This is medical advice [E2].' WHEN turn % 4 = 3 THEN 'Based on the given evidence [E9] it is. ' || text || ' See [E2] and [E3].' ELSE text END AS text FROM conversations WHERE role = 'assistant'),
s AS (SELECT conv_id, turn, cited, list_filter(string_split(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> '') AS s FROM a),
k AS (SELECT conv_id, turn, cited, s AS every, list_filter(s, lambda s: NOT ({_ASIDE}))[1:4] AS kept FROM s),
u AS (SELECT conv_id, turn, cited, CASE WHEN len(kept) > 0 THEN kept ELSE [left(every[1], 300)] END AS c, len(kept) > 0 AS own FROM k WHERE len(every) > 0),
n AS (SELECT conv_id, turn, cited, own, c, unnest(range(1, len(c) + 1)) AS i FROM u)
SELECT conv_id, turn, (i - 1)::INT AS n, c[i] AS claim, array_to_string(CASE WHEN own AND len(regexp_extract_all(c[i], '\[E[0-9]+\]')) > 0 THEN regexp_extract_all(c[i], '\[E[0-9]+\]') ELSE cited END, ',') AS labels FROM n""")
def answer_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of answers as claims, with the labels of the evidence that each names (some answers get an aside or labels)."""
    t, text = F.col("turn") % 4, F.col("text")
    said = F.when(t == 1, F.concat(text, F.lit(" This is medical advice [E2]."))).when(t == 3, F.concat(F.lit("Based on the given evidence [E9] it is. "), text, F.lit(" See [E2] and [E3]."))).otherwise(text)
    cited = F.array(F.lit("[E1]"), F.format_string("[E%d]", 1 + F.col("turn") % 3))
    c = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    found = c.select("conv_id", "turn", F.posexplode(labelled_claims(said, cited)).alias("n", "c"))
    return found.select("conv_id", "turn", "n", "c.claim", F.array_join("c.labels", ",").alias("labels"))


_VERDICT = "CASE l_linenumber % 5 WHEN 0 THEN 'unsupported' WHEN 1 THEN 'Supported by [E1]' WHEN 2 THEN 'contradicted' WHEN 3 THEN 'valid refusal' ELSE 'supported' END"
_FAITH = """f AS (SELECT l_orderkey AS answer, count(*) AS n, CASE WHEN count(*) FILTER (l_linenumber % 5 = 2) = count(*) THEN 0::DOUBLE ELSE round(count(*) FILTER (l_linenumber % 5 IN (1, 3, 4))::DOUBLE / count(*), 4) END AS faithfulness,
bool_or(l_linenumber % 5 = 2) AS contradicted FROM lineitem GROUP BY l_orderkey)"""


def _faith(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("answer"), verdict(F.expr(_VERDICT)).alias("verdict"))
    return faithfulness(li, "answer", "verdict")


@query(f"WITH {_FAITH} SELECT answer, n, faithfulness, contradicted FROM f")
def answer_faithfulness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _faith(spark, sf_dir)


@query(f"""WITH {_FAITH}, c AS (SELECT answer, contradicted, o_orderstatus = 'P' AS refused, round(least(1, greatest(0, 0.4::DOUBLE * least(1, o_totalprice / 400000) + 0.6::DOUBLE * faithfulness)), 3) AS confidence FROM f JOIN orders ON o_orderkey = answer)
SELECT answer, confidence, CASE WHEN confidence >= 0.75 THEN 'high' WHEN confidence >= 0.5 THEN 'medium' ELSE 'low' END AS tier,
NOT refused AND (confidence < 0.5 OR contradicted) AS need_retry, CASE WHEN refused THEN 'refusal' WHEN contradicted THEN 'contradiction_detected' WHEN confidence >= 0.75 THEN 'verified' WHEN confidence >= 0.5 THEN 'caution' ELSE 'uncertain' END AS status FROM c""")
def final_confidence_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("answer"), (F.col("o_orderstatus") == "P").alias("refused"), F.least(F.lit(1.0), F.col("o_totalprice") / 400000).alias("evidence"))
    c = _faith(spark, sf_dir).join(o, "answer").withColumn("confidence", final_confidence(F.col("evidence"), F.col("faithfulness")))
    again = needs_retry(F.col("refused"), F.col("contradicted"), F.col("confidence")).alias("need_retry")
    return c.select("answer", "confidence", again, tier(F.col("confidence")).alias("tier"), answer_status(F.col("refused"), F.col("contradicted"), F.col("confidence")).alias("status"))


_ANSWER = "CASE l_partkey % 7 WHEN 0 THEN 'Please consult your doctor' WHEN 1 THEN 'no idea' ELSE 'Answer: ' || chr((65 + l_suppkey % 4)::INT) || ' because' END"


@query("""SELECT l_returnflag, count(*) AS n, round(100.0::DOUBLE * count(*) FILTER (a AND g = 0) / count(*), 2) AS accuracy, round(100.0::DOUBLE * count(*) FILTER (a AND g = 0) / nullif(count(*) FILTER (a), 0), 2) AS accuracy_answered,
round(100.0::DOUBLE * count(*) FILTER (a) / count(*), 2) AS answered, round(100.0::DOUBLE * count(*) FILTER (NOT a) / count(*), 2) AS refused, round(100.0::DOUBLE * count(*) FILTER (a AND g <> 0) / count(*), 2) AS wrong
FROM (SELECT l_returnflag, l_partkey % 7 > 1 AS a, (l_suppkey - l_orderkey) % 4 AS g FROM lineitem) GROUP BY l_returnflag""")
def benchmark_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    letter = lambda c: F.char((65 + F.col(c) % 4).cast("int"))
    text = F.when(F.col("l_partkey") % 7 == 0, "Please consult your doctor").when(F.col("l_partkey") % 7 == 1, "no idea").otherwise(F.concat(F.lit("Answer: "), letter("l_suppkey"), F.lit(" because")))
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", letter("l_orderkey").alias("gold"), choice(text).alias("given"))
    return qa_metrics(li, ["l_returnflag"], "gold", "given")


@query("SELECT event_type, list_sort(list(value))[len(list(value)) // 2 + 1] AS median, count(*) AS n FROM events GROUP BY event_type")
def upper_median_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upper_median(table(spark, sf_dir, "events"), ["event_type"], "value")
