"""Measurements of lab reports: names, units, ranges, trends and care gaps, batched by user."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions.expressions import any_of, months_between_dates
from quillstone.operators.ranking import top_n

# Aliases, unit factors, reference ranges and monitoring panels.
ALIASES = [
    ("potassium", "Potassium", "mmol/L"), ("k+", "Potassium", "mmol/L"), ("sodium", "Sodium", "mmol/L"), ("na+", "Sodium", "mmol/L"),
    ("hemoglobin", "Hemoglobin", "g/L"), ("hb", "Hemoglobin", "g/L"), ("hgb", "Hemoglobin", "g/L"), ("creatinine", "Creatinine", "umol/L"), ("scr", "Creatinine", "umol/L"),
    ("wbc", "White Blood Cell Count", "10^9/L"), ("white blood cell", "White Blood Cell Count", "10^9/L"), ("white blood cell count", "White Blood Cell Count", "10^9/L"),
    ("glucose", "Glucose", "mmol/L"), ("fasting glucose", "Glucose", "mmol/L"), ("platelet", "Platelet Count", "10^9/L"), ("platelet count", "Platelet Count", "10^9/L"),
    ("plt", "Platelet Count", "10^9/L"), ("inr", "Prothrombin Time INR", ""), ("alt", "Alanine Aminotransferase", "U/L"), ("ast", "Aspartate Aminotransferase", "U/L"),
    ("tsh", "Thyroid Stimulating Hormone", "mIU/L"), ("troponin", "Troponin I", "ng/mL"), ("hemoglobin a1c", "Hemoglobin A1c", "%"), ("hba1c", "Hemoglobin A1c", "%"),
    ("hb a1c", "Hemoglobin A1c", "%"), ("a1c", "Hemoglobin A1c", "%"), ("glycated hemoglobin", "Hemoglobin A1c", "%"), ("urine albumin", "Urine Albumin", "mg/L"),
    ("egfr", "Glomerular Filtration Rate", "mL/min/1.73m2"),
]
FACTORS = [
    ("Creatinine", "mg/dl", "umol/l", 88.4), ("Creatinine", "mg/dl", "µmol/l", 88.4), ("Glucose", "mg/dl", "mmol/l", 0.0555), ("Hemoglobin", "g/dl", "g/l", 10.0),
    ("Potassium", "meq/l", "mmol/l", 1.0), ("Sodium", "meq/l", "mmol/l", 1.0),
]
RANGES = [
    ("Potassium", 3.5, 5.1, 2.8, 6.0), ("Hemoglobin", 120.0, 160.0, 70.0, 200.0), ("Hemoglobin A1c", 4.0, 5.6, None, 10.0), ("Creatinine", 53.0, 115.0, None, 354.0),
    ("Sodium", 135.0, 145.0, 120.0, 160.0), ("Glucose", 3.9, 5.6, 2.8, 25.0),
]
PANELS = [
    ("Type 2 Diabetes Mellitus", ["hba1c", "hemoglobin a1c", "glucose", "fasting glucose", "diabetes"], [
        ("Hemoglobin A1c", ["hba1c", "hemoglobin a1c", "a1c", "glycated hemoglobin"]), ("Creatinine", ["creatinine", "scr", "serum creatinine", "egfr"]),
        ("Urine Albumin", ["urine albumin", "uacr", "albuminuria", "microalbumin"])]),
    ("Hypertension", ["hypertension", "blood pressure", "potassium", "sodium"], [("Creatinine", ["creatinine", "scr", "egfr"]), ("Potassium", ["potassium", "k+"]), ("Sodium", ["sodium", "na+"])]),
    ("Chronic Kidney Disease", ["creatinine", "kidney", "renal", "egfr", "proteinuria"], [("Creatinine", ["creatinine", "scr", "egfr"]), ("Potassium", ["potassium", "k+"]), ("Urine Albumin", ["urine albumin", "uacr", "microalbumin"])]),
]
#: (test, low, high) that a latest value should keep; creatinine's in its normalised unit.
GOALS = [("Hemoglobin A1c", None, 7.0), ("Creatinine", None, 1.2 * 88.4), ("Potassium", 3.5, 5.1)]


def normalised(spark: SparkSession, values: DataFrame, name: str = "test_name", value: str = "value", unit: str = "unit") -> DataFrame:
    """Adds canonical, unit_norm, factor and value_norm (4 digits): by the exact alias, else the longest alias inside the name.

    Factors go by canonical name and units; units without a factor keep their value and unit. The tables are fixed and small.
    """
    aliases = F.broadcast(spark.createDataFrame(ALIASES, "alias string, canonical string, target string"))
    factors = F.broadcast(spark.createDataFrame(FACTORS, "canonical string, unit_from string, unit_to string, factor double"))
    clean = F.trim(F.lower(F.regexp_replace(name, r"\(.*?\)", "")))
    names = values.select(name).distinct().withColumn("clean", clean)
    held = names.join(aliases, F.col("clean").contains(F.col("alias")), "left")
    best = held.groupBy(name).agg(F.max_by(F.struct("canonical", "target"), F.struct((F.col("clean") == F.col("alias")).alias("e"), F.length("alias").alias("n"), "alias")).alias("b"))
    best = best.select(F.col(name), F.coalesce("b.canonical", F.trim(name)).alias("canonical"), F.nullif("b.target", F.lit("")).alias("target"))
    out = values.join(best, name, "left").withColumns({"unit_from": F.lower(F.trim(unit)), "unit_to": F.lower(F.coalesce("target", unit))})
    out = out.join(factors, ["canonical", "unit_from", "unit_to"], "left")
    same = F.col("unit_from") == F.col("unit_to")
    known = F.col("factor").isNotNull() | F.coalesce(same, F.lit(False))
    return out.withColumns({
        "unit_norm": F.when(known, F.coalesce("target", unit)).otherwise(F.col(unit)), "factor": F.coalesce("factor", F.lit(1.0)), "value_norm": F.round(F.col(value) * F.coalesce("factor", F.lit(1.0)), 4),
    }).drop("unit_from", "unit_to", "target")


def assessed(values: DataFrame, ranges: DataFrame, key: str = "canonical", value: str = "value_norm") -> DataFrame:
    """Adds class: critical_low, critical_high, low, high, normal, or uninterpretable without a range.

    The reference range (low, high, critical_low, critical_high by key), else the report's own ref_low and ref_high with
    criticals at 0.7 times low and 1.5 times high.
    """
    r = values.join(ranges.withColumn("known", F.lit(True)), key, "left")
    own = F.col("known").isNull()
    low, high = F.coalesce("low", F.when(own, F.col("ref_low"))), F.coalesce("high", F.when(own, F.col("ref_high")))
    c_low = F.when(own, F.col("ref_low") * 0.7).otherwise(F.col("critical_low"))
    c_high = F.when(own, F.col("ref_high") * 1.5).otherwise(F.col("critical_high"))
    v = F.col(value)
    kind = F.when(low.isNull() & high.isNull(), "uninterpretable").when(v <= c_low, "critical_low").when(v >= c_high, "critical_high").when(v < low, "low").when(v > high, "high").otherwise("normal")
    return r.withColumn("class", F.when(v.isNull(), "uninterpretable").otherwise(kind)).drop("known", "low", "high", "critical_low", "critical_high")


def direction(name: Column, first: Column, last: Column, low: Column, high: Column) -> Column:
    """resolved, worsening, improving or stable, with its significance: ``struct(direction, significant)``."""
    delta = F.round(last - first, 4)
    out = lambda v: F.coalesce(v > high, F.lit(False)) | F.coalesce(v < low, F.lit(False))
    t = F.lower(name)
    made = lambda d, s: F.struct(F.lit(d).alias("direction"), F.lit(s).alias("significant"))
    relative = F.abs(delta) / F.when(F.abs(first) > 1e-6, F.abs(first)).otherwise(1.0)
    way = F.when(delta > 0, made("worsening", False)).otherwise(made("improving", False))
    above = F.coalesce(first > high, F.lit(False))
    return (
        F.when(out(first) & ~out(last), made("resolved", True)).when(~out(first) & out(last), made("worsening", True))
        .when(out(first) & above, F.when(last > first, made("worsening", True)).otherwise(made("improving", True)))
        .when(out(first), F.when(last < first, made("worsening", True)).otherwise(made("improving", True)))
        .when(t.contains("creatinine"), F.when(delta >= 0.3, made("worsening", True)).when(delta <= -0.3, made("improving", True)).when(F.abs(delta) <= 0.15, made("stable", False)).otherwise(way))
        .when(t.contains("a1c"), F.when(delta >= 0.5, made("worsening", True)).when(delta <= -0.5, made("improving", True)).when(F.abs(delta) <= 0.3, made("stable", False)).otherwise(way))
        .when(t.contains("potassium"), F.when(F.abs(delta) <= 0.3, made("stable", False)).otherwise(way))
        .when((relative <= 0.08) | (F.abs(delta) < 0.01), made("stable", False)).otherwise(way)
    )


def trends(series: DataFrame, user: str, test: str, value: str, date: str, ord_col: str) -> DataFrame:
    """One row per user and test: earliest and latest, delta (4 digits), rate a month (4 digits), direction, significance.

    Needs ref_low, ref_high and critical columns. One measurement is new, and significant if critical. Repeated
    (user, test, date, value) rows count once. One aggregation by user and test; nothing is sorted.
    """
    order = F.struct(F.col(date), F.col(ord_col))
    once = series.groupBy(user, test, date, value).agg(F.min(ord_col).alias(ord_col), F.max("ref_low").alias("ref_low"), F.max("ref_high").alias("ref_high"), F.max("critical").alias("critical"))
    row = F.struct(F.col(value).alias("v"), F.col(date).alias("d"), F.col("ref_low").alias("lo"), F.col("ref_high").alias("hi"), F.col("critical").alias("c"))
    g = once.groupBy(user, test).agg(F.min_by(row, order).alias("a"), F.max_by(row, order).alias("b"), F.count(F.lit(1)).alias("points"))
    delta = F.round(F.col("b.v") - F.col("a.v"), 4)
    found = direction(F.col(test), F.col("a.v"), F.col("b.v"), F.coalesce("b.lo", "a.lo"), F.coalesce("b.hi", "a.hi"))
    single = F.col("points") == 1
    new = F.struct(F.lit("new").alias("direction"), F.col("b.c").alias("significant"))
    g = g.withColumn("f", F.when(single, new).otherwise(found))
    rate = F.round(delta / months_between_dates(F.col("a.d").cast("date"), F.col("b.d").cast("date")), 4)
    return g.select(
        user, test, "points", F.col("a.v").alias("earliest"), F.col("b.v").alias("latest"), F.when(~single, delta).alias("delta"), F.when(~single, rate).alias("rate_per_month"),
        F.col("f.direction").alias("direction"), F.col("f.significant").alias("significant"),
    )


def missing_checks(spark: SparkSession, tests: DataFrame, user: str = "user_id", test: str = "test_name", panels: list = PANELS) -> DataFrame:
    """(user, condition, check): checks of a condition's panel that a user with one of its triggers has no test for."""
    rules = [(c, check, [t.lower() for t in triggers], aliases) for c, triggers, checks in panels for check, aliases in checks]
    has, per = tests.withColumn("_t", F.lower(test)), []
    for c, check, triggers, aliases in rules:  # a fixed small list: one pass over the tests, two booleans a rule
        per += [F.max(any_of(F.col("_t"), triggers)).alias(f"{c}|{check}|on"), F.max(any_of(F.col("_t"), aliases)).alias(f"{c}|{check}|has")]
    by_user = has.groupBy(user).agg(*per)
    gaps = F.array_compact(F.array(*[F.when(F.col(f"`{c}|{k}|on`") & ~F.col(f"`{c}|{k}|has`"), F.struct(F.lit(c).alias("condition"), F.lit(k).alias("check"))) for c, k, _, _ in rules]))
    return by_user.select(user, F.explode(gaps).alias("g")).select(user, "g.condition", "g.check")


def out_of_target(spark: SparkSession, latest: DataFrame, user: str = "user_id", test: str = "canonical", value: str = "value_norm") -> DataFrame:
    """(user, test, value): latest values outside their goal."""
    goals = F.broadcast(spark.createDataFrame(GOALS, f"{test} string, goal_low double, goal_high double"))
    j = latest.join(goals, test)
    return j.where((F.col(value) > F.col("goal_high")) | (F.col(value) < F.col("goal_low"))).select(user, test, value)


def latest_values(values: DataFrame, user: str, test: str, order: list[Column]) -> DataFrame:
    return top_n(values, [user, test], order, 1, "_n").drop("_n")


LINE = r"^\s*([A-Za-z][A-Za-z0-9 ()/+-]*?)\s*[:=]?\s+([0-9]+(?:\.[0-9]+)?)\s*([A-Za-zµ%/^0-9.]*?)\s*(?:[\[(]?\s*([0-9]+(?:\.[0-9]+)?)\s*[-–]\s*([0-9]+(?:\.[0-9]+)?)\s*[\])]?)?\s*$"


def report_lines(lines: DataFrame, text: str = "line") -> DataFrame:
    """Adds test_name, value, unit, ref_low, ref_high of lines of the form ``name: value unit (low-high)``; others go."""
    part = lambda i: F.nullif(F.regexp_extract(text, LINE, i), F.lit(""))
    return lines.where(F.col(text).rlike(LINE)).withColumns({"test_name": part(1), "value": part(2).cast("double"), "unit": part(3), "ref_low": part(4).cast("double"), "ref_high": part(5).cast("double")})
