"""What is shown or stored of rows: nodes of tests and chunks, batches to resume from, filtered citations, whole reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.functions.expressions import key16, safe_float
from quillstone.operators.lab import assessed, normalised
from quillstone.operators.tabular import field

# What a category holds for each kind of citation that can be asked for.
KINDS = {
    "guideline": ["guideline"],
    "research_paper": ["research", "paper", "pubmed"],
    "drug": ["drug", "medication"],
    "private_report": ["private", "report"],
}
# Fixed value: what a report with a critical value says first.
ESCALATION = "Critical values: seek care now."


def batches(df: DataFrame, index: str, start: int, size: int) -> DataFrame:
    """Adds batch to the rows from index ``start`` on: their number among those of ``size`` consecutive indices."""
    return df.where(F.col(index) >= start).withColumn("batch", F.floor((F.col(index) - start) / size))


def test_nodes(rows: DataFrame, headers: str = "headers", cells: str = "cells", source: str = "source_doc") -> DataFrame:
    """A node of each table row that names a test, under whichever of its headers; other fields are '' where none says anything,
    normal bounds are numbers or null. The key is of name, specimen, age group, gender and source."""

    def one(most: int, *names: str) -> Column:
        return F.substring(F.coalesce(field(F.col(headers), F.col(cells), *names), F.lit("")), 1, most)

    found = rows.select(
        F.col(source).alias("source_doc"),
        one(200, "Test Name", "Component Name").alias("test_name"),
        one(100, "Category", "Category of Lab Test").alias("category"),
        one(200, "Specimen", "System").alias("specimen"),
        safe_float(field(F.col(headers), F.col(cells), "Normal Low")).alias("normal_low"),
        safe_float(field(F.col(headers), F.col(cells), "Normal High")).alias("normal_high"),
        one(50, "Critical Low").alias("critical_low"),
        one(50, "Critical High").alias("critical_high"),
        one(50, "Unit", "Traditional Units").alias("unit"),
        one(100, "Age Group").alias("age_group"),
        one(50, "Gender").alias("gender"),
    ).where("test_name <> ''")
    key = key16(*[F.col(c) for c in ("test_name", "specimen", "age_group", "gender", "source_doc")])
    return found.select(key.alias("lab_test_id"), "*")


def chunk_nodes(chunks: DataFrame, documents: DataFrame, document: str = "document_id") -> DataFrame:
    """Chunks as nodes, with the metadata (category and the like) that all chunks of a document share; counts as integers."""
    out = chunks.join(documents, document)
    typed = {"token_count": F.col("token_count").cast("int"), "faiss_id": F.col("faiss_id").cast("long"), "source_doc": F.col(document)}
    return out.withColumns(typed)


# The bounds that a report's page shows for tests that come without, by a part of the test's name.
SHOWN_RANGES = [("creatinine", 53.0, 115.0), ("potassium", 3.5, 5.0), ("hba1c", 4.0, 5.7), ("a1c", 4.0, 5.7), ("glucose", 3.9, 5.6), ("egfr", 60.0, 120.0)]


def citations_of(citations: DataFrame, by: str, category: str, score: str, item: str) -> DataFrame:
    """(shown, by, item, rank): a query's citations of every kind that can be asked for, and all of them, best score first."""
    low = F.lower(F.coalesce(F.col(category), F.lit("")))
    held = [F.when(F.greatest(*[low.contains(w) for w in words], F.lit(False)), F.lit(kind)) for kind, words in KINDS.items()]
    each = citations.select(F.explode(F.array_compact(F.array(F.lit("all"), *held))).alias("shown"), by, item, score)
    order = Window.partitionBy(by, "shown").orderBy(F.desc(score), F.asc(item))
    return each.select("shown", by, item, F.row_number().over(order).alias("rank"))


def with_default_ranges(values: DataFrame, name: str = "test_name", low: str = "ref_low", high: str = "ref_high") -> DataFrame:
    """``low`` and ``high`` as a report gives them both; if either is missing, both of the first kind of test that is part of the name, if any."""
    told = F.lower(F.coalesce(F.col(name), F.lit("")))
    lacks = F.col(low).isNull() | F.col(high).isNull()
    ends = [F.coalesce(*[F.when(told.contains(part), F.lit(bound)) for part, *bounds in SHOWN_RANGES for bound in bounds[i : i + 1]], F.col(end)) for i, end in enumerate((low, high))]
    return values.withColumns({low: F.when(lacks, ends[0]).otherwise(F.col(low)), high: F.when(lacks, ends[1]).otherwise(F.col(high))})


def interpreted(spark: SparkSession, values: DataFrame, ranges: DataFrame, by: list[str], order: str, source: str, kind: str) -> DataFrame:
    """(by, values, critical, summary, escalation, provenance) of each report: its values in normal units, held against their ranges,
    and the different sources in the order in which its values name them. ``kind`` is the report's format."""
    found = assessed(normalised(spark, values), ranges)
    per = found.groupBy(*by, kind).agg(
        F.count(F.lit(1)).alias("values"),
        F.max(F.col("class").startswith("critical")).alias("critical"),
        F.sort_array(F.collect_list(F.struct(order, source))).alias("_s"),  # one report's values
    )
    summary = F.concat(F.lit("Parsed "), F.upper(kind), F.lit(" report ("), F.col("values").cast("string"), F.lit(" lab values extracted)."))
    sources = F.array_distinct(F.transform("_s", lambda x: x[source]))
    return per.select(
        *by, "values", "critical", summary.alias("summary"), F.when(F.col("critical"), ESCALATION).alias("escalation"), F.array_join(sources, ",").alias("provenance")
    )
