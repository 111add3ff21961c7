"""Measurement queries: users' events as tests, with ranges, trends, gaps and report summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators.lab import assessed, direction, latest_values, missing_checks, normalised, out_of_target, trends
from quillstone.operators.ranking import first_last, scaled
from quillstone.functions.tables import numbered, written
from quillstone.operators.aliases import UNIT_FACTORS, mapped_names, with_unit_factor
from quillstone.plans.catalog import query, table

# Stand-ins: event types as tests (name, unit) with ranges for their values.
TESTS = {"click": ("Creatinine (serum)", "mg/dL"), "view": ("HbA1c", "%"), "purchase": ("Potassium", "mEq/L"), "signup": ("Fasting Glucose", "mg/dL")}
_TEST = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{n}'" for k, (n, _) in TESTS.items()) + " ELSE 'Ferritin' END"
_UNIT = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{u}'" for k, (_, u) in TESTS.items()) + " ELSE 'ug/L' END"
_CANON = "CASE event_type WHEN 'click' THEN 'Creatinine' WHEN 'view' THEN 'Hemoglobin A1c' WHEN 'purchase' THEN 'Potassium' WHEN 'signup' THEN 'Glucose' ELSE 'Ferritin' END"
_FACTOR = "CASE event_type WHEN 'click' THEN 88.4::DOUBLE WHEN 'signup' THEN 0.0555::DOUBLE ELSE 1.0::DOUBLE END"
_LOW, _HIGH, _CLOW, _CHIGH = 20.0, 80.0, 5.0, 95.0


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "user_id", "event_type", F.col("ts").cast("date").alias("day"), "value", F.expr(_TEST).alias("test_name"), F.expr(_UNIT).alias("unit"))


@query(f"SELECT event_id, {_CANON} AS canonical, {_FACTOR} AS factor, value * {_FACTOR} AS product, CASE event_type WHEN 'click' THEN 'umol/L' WHEN 'purchase' THEN 'mmol/L' WHEN 'signup' THEN 'mmol/L' ELSE {_UNIT} END AS unit_norm FROM events")
def lab_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalised(spark, measurements(spark, sf_dir)).select("event_id", "canonical", "factor", (F.col("value") * F.col("factor")).alias("product"), "unit_norm")


_ASSESSED = f"""SELECT event_id, user_id, event_type, CASE WHEN event_type = 'click' THEN 'uninterpretable' WHEN event_type = 'view' THEN CASE WHEN value <= {_CLOW} THEN 'critical_low' WHEN value >= {_CHIGH} THEN 'critical_high' WHEN value < {_LOW} THEN 'low' WHEN value > {_HIGH} THEN 'high' ELSE 'normal' END
ELSE CASE WHEN value <= 30 * 0.7::DOUBLE THEN 'critical_low' WHEN value >= 60 * 1.5::DOUBLE THEN 'critical_high' WHEN value < 30 THEN 'low' WHEN value > 60 THEN 'high' ELSE 'normal' END END AS class FROM events"""


def _classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = spark.createDataFrame([("view", _LOW, _HIGH, _CLOW, _CHIGH)], "event_type string, low double, high double, critical_low double, critical_high double")
    own = F.when(F.col("event_type") != "click", F.lit(30.0)), F.when(F.col("event_type") != "click", F.lit(60.0))
    m = measurements(spark, sf_dir).withColumns({"ref_low": own[0], "ref_high": own[1]})
    return assessed(m, F.broadcast(ranges), "event_type", "value")


@query(_ASSESSED)
def lab_assess(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classes(spark, sf_dir).select("event_id", "user_id", "event_type", "class")


@query(f"SELECT user_id, count(*) AS n, count(*) FILTER (class LIKE 'critical%') AS critical, bool_or(class LIKE 'critical%') AS any_critical FROM ({_ASSESSED}) GROUP BY user_id")
def report_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    critical = F.col("class").startswith("critical")
    return _classes(spark, sf_dir).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(critical).alias("critical"), F.max(critical).alias("any_critical"))


@query(f"SELECT user_id, event_id, event_type, class, row_number() OVER (PARTITION BY user_id ORDER BY event_type, event_id) AS line FROM ({_ASSESSED})")
def report_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    return _classes(spark, sf_dir).select("user_id", "event_id", "event_type", "class", F.row_number().over(Window.partitionBy("user_id").orderBy("event_type", "event_id")).alias("line"))


_GROUPED = f"""d AS (SELECT user_id, {_TEST} AS test_name, ts::DATE AS day, value, min(event_id) AS event_id FROM events GROUP BY ALL),
g AS (SELECT user_id, test_name, arg_min(value, (day, event_id)) AS a, arg_max(value, (day, event_id)) AS b, min(day) AS da, max(day) AS db, count(*) AS points FROM d GROUP BY ALL)"""
_DIR = f"""CASE WHEN (a > {_HIGH} OR a < {_LOW}) AND NOT (b > {_HIGH} OR b < {_LOW}) THEN 'resolved' WHEN NOT (a > {_HIGH} OR a < {_LOW}) AND (b > {_HIGH} OR b < {_LOW}) THEN 'worsening'
WHEN a > {_HIGH} THEN CASE WHEN b > a THEN 'worsening' ELSE 'improving' END WHEN a < {_LOW} THEN CASE WHEN b < a THEN 'worsening' ELSE 'improving' END
WHEN test_name LIKE 'Creat%' THEN CASE WHEN abs(delta) <= 0.15 THEN 'stable' WHEN delta > 0 THEN 'worsening' ELSE 'improving' END
WHEN test_name IN ('HbA1c', 'Potassium') THEN CASE WHEN abs(delta) <= 0.3 THEN 'stable' WHEN delta > 0 THEN 'worsening' ELSE 'improving' END
WHEN abs(delta) / CASE WHEN abs(a) > 1e-6 THEN abs(a) ELSE 1 END <= 0.08 OR abs(delta) < 0.01 THEN 'stable' WHEN delta > 0 THEN 'worsening' ELSE 'improving' END"""
_SIG = f"""CASE WHEN (a > {_HIGH} OR a < {_LOW}) OR (b > {_HIGH} OR b < {_LOW}) THEN true WHEN test_name LIKE 'Creat%' THEN abs(delta) >= 0.3 WHEN test_name = 'HbA1c' THEN abs(delta) >= 0.5 ELSE false END"""


@query(f"""WITH {_GROUPED} SELECT user_id, test_name, points, a AS earliest, b AS latest, CASE WHEN points > 1 THEN delta END AS delta,
CASE WHEN points > 1 AND db - da >= 14 THEN round(delta / greatest(0.2::DOUBLE, (db - da) / 30.4375::DOUBLE), 4) END AS rate_per_month,
CASE WHEN points = 1 THEN 'new' ELSE {_DIR} END AS direction, CASE WHEN points = 1 THEN b >= 95 ELSE {_SIG} END AS significant FROM (SELECT *, round(b - a, 4) AS delta FROM g)""")
def trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = measurements(spark, sf_dir).withColumns({"ref_low": F.lit(_LOW), "ref_high": F.lit(_HIGH), "critical": F.col("value") >= 95})
    return trends(m, "user_id", "test_name", "value", "day", "event_id")


@query(f"WITH {_GROUPED} SELECT user_id, test_name, points, a AS first_value, b AS last_value FROM g")
def series_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    once = measurements(spark, sf_dir).groupBy("user_id", "test_name", "day", "value").agg(F.min("event_id").alias("event_id"))
    return first_last(once, ["user_id", "test_name"], F.struct("day", "event_id"), ["value"]).withColumnRenamed("n", "points")


@query("SELECT event_id, round(CASE WHEN max(value) OVER w = min(value) OVER w THEN 1 ELSE (value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) END, 6) AS scaled FROM events WINDOW w AS (PARTITION BY user_id, event_type)")
def scaled_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scaled(table(spark, sf_dir, "events"), ["user_id", "event_type"], "value").select("event_id", F.round("scaled", 6).alias("scaled"))


_HAS = "h AS (SELECT user_id, bool_or(event_type = 'click') AS cr, bool_or(event_type = 'view') AS a1c, bool_or(event_type = 'purchase') AS k, bool_or(event_type = 'signup') AS glu FROM events GROUP BY user_id)"


@query(f"""WITH {_HAS} SELECT user_id, c AS condition, t AS "check" FROM h, (VALUES ('Type 2 Diabetes Mellitus', 'Hemoglobin A1c'), ('Type 2 Diabetes Mellitus', 'Creatinine'), ('Type 2 Diabetes Mellitus', 'Urine Albumin'),
('Hypertension', 'Creatinine'), ('Hypertension', 'Potassium'), ('Hypertension', 'Sodium'), ('Chronic Kidney Disease', 'Creatinine'), ('Chronic Kidney Disease', 'Potassium'), ('Chronic Kidney Disease', 'Urine Albumin')) p(c, t)
WHERE CASE c WHEN 'Hypertension' THEN k WHEN 'Chronic Kidney Disease' THEN cr ELSE a1c OR glu END AND NOT CASE t WHEN 'Hemoglobin A1c' THEN a1c WHEN 'Creatinine' THEN cr WHEN 'Potassium' THEN k ELSE false END""")
def caregap_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's kinds of events are the tests that were done."""
    return missing_checks(spark, measurements(spark, sf_dir))


@query(f"""SELECT user_id, canonical, value_norm FROM (SELECT user_id, {_CANON} AS canonical, round(value * {_FACTOR}, 4) AS value_norm, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts::DATE DESC, event_id DESC) AS r FROM events)
WHERE r = 1 AND CASE canonical WHEN 'Hemoglobin A1c' THEN value_norm > 7 WHEN 'Creatinine' THEN value_norm > 1.2::DOUBLE * 88.4::DOUBLE WHEN 'Potassium' THEN value_norm > 5.1 OR value_norm < 3.5 ELSE false END""")
def caregap_out_of_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = latest_values(normalised(spark, measurements(spark, sf_dir)), "user_id", "canonical", [F.desc("day"), F.desc("event_id")])
    return out_of_target(spark, latest)


@query(f"SELECT event_id, {_DIR} AS direction FROM (SELECT event_id, {_TEST} AS test_name, value AS a, event_id % 100 AS b, round(event_id % 100 - value, 4) AS delta FROM events)")
def trend_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = measurements(spark, sf_dir)
    return e.select("event_id", direction(F.col("test_name"), F.col("value"), (F.col("event_id") % 100).cast("double"), F.lit(_LOW), F.lit(_HIGH))["direction"].alias("direction"))


_ALIASED = r"""al AS (SELECT w AS alias, row_number() OVER (ORDER BY encode(w)) AS ord, upper(w) AS canonical, CASE WHEN length(w) % 2 = 0 THEN 'u' || length(w) END AS target FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{7,}')) AS w FROM documents)),
nm AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN ' ' || b.text[:40] || ' (of ' || o_orderkey || ')' WHEN 1 THEN upper(a.alias) WHEN 2 THEN p_name ELSE 'x' || o_custkey END AS name
  FROM orders JOIN benchmark b ON b.item_id = o_orderkey % 40 JOIN al a ON a.ord = 1 + o_orderkey % 500 JOIN part ON p_partkey = o_orderkey % 100)"""


@query(rf"""WITH {_ALIASED}, c AS (SELECT DISTINCT name, trim(regexp_replace(lower(trim(name, ' ')), '\(.*?\)', '', 'g'), ' ') AS clean FROM nm),
m AS (SELECT clean, arg_max({{'c': canonical, 't': target, 'e': clean = alias}}, (clean = alias, length(alias), -ord)) AS m FROM (SELECT DISTINCT clean FROM c) JOIN al ON contains(clean, alias) GROUP BY clean),
t AS (SELECT clean, arg_min(s_name, s_suppkey) AS test FROM (SELECT DISTINCT clean FROM c WHERE clean <> '' AND clean NOT IN (SELECT clean FROM m)) JOIN (SELECT s_suppkey, s_name || ' ' || p_name AS s_name FROM supplier JOIN part ON p_partkey = s_suppkey) ON contains(lower(s_name), clean[:15]) GROUP BY clean)
SELECT o_orderkey, coalesce(m.c, test, nm.name) AS canonical, m.t AS target, CASE WHEN m.e THEN 1.0::DOUBLE WHEN m.c IS NOT NULL THEN 0.85::DOUBLE WHEN test IS NOT NULL THEN 0.8::DOUBLE ELSE 0.5::DOUBLE END AS confidence
FROM nm JOIN c ON c.name = nm.name LEFT JOIN m ON m.clean = c.clean LEFT JOIN t ON t.clean = c.clean""")
def mapped_test_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' texts as names of tests, with the words of seven letters or more of all documents as aliases, and suppliers' names as tests."""
    d, o, b, p, s = (table(spark, sf_dir, t) for t in ("documents", "orders", "benchmark", "part", "supplier"))
    words = d.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{7,}"), F.lit(0))).alias("alias")).distinct()
    words = written(numbered(words, ["alias"], "ord"), "words")
    target = F.when(F.length("alias") % 2 == 0, F.concat(F.lit("u"), F.length("alias").cast("string")))
    aliases = words.select("alias", "ord", F.upper("alias").alias("canonical"), target.alias("target"))
    few = words.where("ord <= 500").select(F.col("alias").alias("_alias"), (F.col("ord") - 1).alias("_a"))
    k = F.col("o_orderkey")
    rows = o.join(F.broadcast(b.select(F.col("item_id").alias("_b"), "text")), k % 40 == F.col("_b")).join(F.broadcast(few), k % 500 == F.col("_a"))  # a benchmark; 500 words
    rows = rows.join(p.where("p_partkey < 100").select(F.col("p_partkey").alias("_p"), "p_name"), k % 100 == F.col("_p"))
    said = F.when(k % 4 == 0, F.concat(F.lit(" "), F.substring("text", 1, 40), F.lit(" (of "), k.cast("string"), F.lit(")"))).when(k % 4 == 1, F.upper("_alias")).when(k % 4 == 2, F.col("p_name"))
    names = rows.select("o_orderkey", said.otherwise(F.concat(F.lit("x"), F.col("o_custkey").cast("string"))).alias("name"))
    tests = s.join(p, F.col("s_suppkey") == F.col("p_partkey")).select(F.col("s_suppkey").alias("ord"), F.concat_ws(" ", "s_name", "p_name").alias("test_name"))
    return mapped_names(names, "name", aliases, tests).select("o_orderkey", "canonical", "target", "confidence")


_UNITS = "['mg/dL', 'mmol/L', 'umol/l', 'g/dl', 'G/L', ' meq / l ']"
_FACTOR_KEYS = ", ".join(f"('{k}', {f}::DOUBLE, {i})" for i, (k, f) in enumerate(UNIT_FACTORS))


@query(f"""WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey, ['creatinine', 'glucose', 'potassium', 'hemoglobin', 'hb', 'so'][1 + l_partkey % 6] AS n, {_UNITS}[1 + l_suppkey % 6] AS u, {_UNITS}[1 + l_linenumber % 6] AS t FROM lineitem),
w AS (SELECT *, replace(lower(trim(u, ' ')), ' ', '') AS a, replace(lower(trim(t, ' ')), ' ', '') AS b FROM v), k AS (SELECT * FROM (VALUES {_FACTOR_KEYS}) AS k(k, f, i)),
d AS (SELECT DISTINCT n, a, b FROM w), f AS (SELECT n, a, b, coalesce((SELECT any_value(k.f) FROM k WHERE k.k = n || '_' || a || '->' || b), CASE WHEN a = b THEN 1.0::DOUBLE END,
  (SELECT arg_min(k.f, k.i) FROM k WHERE starts_with(k.k, n) AND contains(k.k, a) AND contains(k.k, b)), 1.0::DOUBLE) AS factor FROM d)
SELECT l_orderkey, l_linenumber, l_partkey, factor FROM w JOIN f USING (n, a, b)""")
def unit_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Factors between units, by exact keys, equal units, and the first key that fits."""
    li = table(spark, sf_dir, "lineitem")
    units = F.expr(f"array({_UNITS[1:-1]})")
    name = F.get(F.array(*map(F.lit, ["creatinine", "glucose", "potassium", "hemoglobin", "hb", "so"])), (F.col("l_partkey") % 6).cast("int"))
    rows = with_unit_factor(li, name, F.get(units, (F.col("l_suppkey") % 6).cast("int")), F.get(units, F.col("l_linenumber") % 6))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "factor")
