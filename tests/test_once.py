"""Work that is done once: a unit factor per different key, a cell per field."""

from pyspark.sql import functions as F

from quillstone.operators.aliases import unit_factor, with_unit_factor
from quillstone.operators.concepts import term_rows
from quillstone.operators.tabular import said_critical
from quillstone.plans.concepts import concept_names


def test_unit_factor_of_different_keys(spark):
    rows = [(i, n, u, t) for i, (n, u, t) in enumerate([("creatinine", "mg/dL", "umol/l"), ("glucose", " mg / dL", "mmol/L"), ("hb", "g/L", "g/L"), (None, None, None), ("so", "x", "y"), ("creatinine", "mg/dL", "umol/l")])]
    df = spark.createDataFrame(rows, "i int, n string, u string, t string")
    keys = (F.col("n"), F.col("u"), F.col("t"))
    found = with_unit_factor(df, *keys)
    assert {r.i: r.factor for r in found.collect()} == {r.i: r.f for r in df.select("i", unit_factor(*keys).alias("f")).collect()}
    assert "RLike" not in found._jdf.queryExecution().toString() and "regexp_replace" not in found._jdf.queryExecution().toString()


def test_a_field_is_read_once(spark):
    df = spark.createDataFrame([(["Test Name", "Normal Low", "Critical Low", "Unit"], ["K", "3", "2", "mmol/L"])], "h array<string>, c array<string>")
    said = df.select(said_critical(F.col("h"), F.col("c")).alias("t"))
    assert said.first().t == "K: normal low 3 mmol/L; critical low 2 mmol/L."
    assert said._jdf.queryExecution().analyzed().toString().count("reverse(") == 1


def test_cells_of_a_term_row_are_made_once(spark):
    line = ["C1", "ENG", *[""] * 4, "Y", *[""] * 4, "NCI", "", "A7", "term", "", "N"]
    df = spark.createDataFrame([(",".join(x),) for x in (line, line[:14], [*line[:16], "Y"], ["C2", *line[1:]], line[:15])], "r string")
    found = term_rows(df.select(F.when(F.length("r") > 3, F.split(F.reverse(F.reverse("r")), ",")).otherwise(F.array()).alias("cells")), spark.createDataFrame([("C1",)], "id string"))
    assert sorted(map(tuple, found.collect())) == [("C1", "NCI", "A7", "term", True, 8)] * 2
    assert found._jdf.queryExecution().optimizedPlan().toString().count("reverse(reverse(") == 1


def test_concept_names_read_lines_once(spark, sf_dir):
    assert concept_names(spark, sf_dir)._jdf.queryExecution().sparkPlan().toString().count("FileScan parquet") == 2  # lines and parts
