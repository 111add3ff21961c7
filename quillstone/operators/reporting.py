"""Reports of an ingest and rules around it: counts at three levels, routing with what it leaves out, external ids, signed changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions.expressions import months_between_dates
from quillstone.operators.dedup import last_wins

# Categories whose texts go to the vector index, to the graph, or to both; characters from which a test's prose is indexed too.
VECTOR, GRAPH, BOTH, PROSE = ("textbook", "research_paper", "guideline"), ("ontology", "lab_reference", "drug"), ("drug_label", "clinical_note"), 200


def summary_report(files: DataFrame, folder: str, kind: str, status: str) -> DataFrame:
    """(section, name, succeeded, failed, skipped, total) for each folder, each format and all files, from one pass."""
    rows = files.select(F.col(folder).alias("folder"), F.col(kind).alias("kind"), F.lower(F.trim(status)).alias("status"))
    sets = rows.groupingSets([[F.col("folder")], [F.col("kind")], []], F.col("folder"), F.col("kind"))
    good = F.col("status").isin("success", "succeeded")
    counts = sets.agg(
        F.grouping_id().alias("_g"), F.count_if(good).alias("succeeded"), F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(F.col("status") == "skipped").alias("skipped"), F.count(F.lit(1)).alias("total"),
    )
    section = F.when(F.col("_g") == 1, "folder").when(F.col("_g") == 2, "format").otherwise("all")
    return counts.select(section.alias("section"), F.coalesce("folder", "kind", F.lit("")).alias("name"), "succeeded", "failed", "skipped", "total")


def write_report(report: DataFrame, path: str) -> None:
    """The report as one JSON file a section, its rows in order (a row per folder and format)."""
    report.repartition("section").sortWithinPartitions("name").write.mode("overwrite").partitionBy("section").json(path)


def target(category: Column, text: Column, structured: Column, lang: Column, keep: tuple[str, ...] = ("en",)) -> Column:
    """faiss, graph, both or none: by category; rows in tables add the graph, prose of a test's page above PROSE characters adds the
    vectors; a language that isn't kept (null is English) gives none."""
    vectors = category.isin(*VECTOR, *BOTH) | ((category == "lab_reference") & (F.length(text) > PROSE))
    graph = category.isin(*GRAPH, *BOTH) | (F.coalesce(structured, F.lit(0)) > 0)
    both = F.when(vectors & graph, "both").when(vectors, "faiss").when(graph, "graph").otherwise("none")
    return F.when(~F.coalesce(lang, F.lit("en")).isin(*keep), "none").otherwise(both)


def vector_rows(docs: DataFrame, target_col: str = "target", lang: str = "lang", keep: tuple[str, ...] = ("en",)) -> tuple[DataFrame, DataFrame]:
    """(rows for the vector index, counts of those left out by language and by target)."""
    spoken, wanted = F.coalesce(F.col(lang), F.lit("en")).isin(*keep), F.col(target_col).isin("faiss", "both")
    counts = docs.agg(F.count_if(spoken & wanted).alias("kept"), F.count_if(~spoken).alias("other_language"), F.count_if(spoken & ~wanted).alias("other_target"))
    return docs.where(spoken & wanted), counts


def without_prefixes(rows: DataFrame, column: str, prefixes: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows whose id begins with none of some prefixes, the number left out by each: the first that fits)."""
    first = F.coalesce(*[F.when(F.col(column).startswith(p), F.lit(p)) for p in prefixes])
    marked = rows.withColumn("_prefix", first)
    left = marked.where("_prefix is not null").groupBy(F.col("_prefix").alias("prefix")).agg(F.count(F.lit(1)).alias("excluded"))
    return marked.where("_prefix is null").drop("_prefix"), left


def external_ids(items: DataFrame, name: str, own: str, known: DataFrame, known_name: str, known_id: str, ord_col: str) -> DataFrame:
    """``items`` with external_id: that of the last known row of the same name (case and blanks at its ends aside), else its own id."""
    plain = lambda c: F.lower(F.trim(F.col(c)))
    last = last_wins(known.where(plain(known_name) != "").select(plain(known_name).alias("_name"), F.col(known_id).alias("_id"), F.col(ord_col).alias("_ord")), "_name", "_ord")
    out = items.withColumn("_name", plain(name)).join(last.drop("_ord"), "_name", "left")
    return out.withColumn("external_id", F.coalesce(F.col("_id").cast("string"), F.col(own).cast("string"))).drop("_name", "_id")


def with_codes(items: DataFrame, key: str, codes: DataFrame, code_key: str, code: str) -> DataFrame:
    """``items`` with codes: all different codes of their key in order, none for keys without. A key's codes are reduced before the join."""
    lists = codes.groupBy(F.col(code_key).alias(key)).agg(F.array_sort(F.collect_set(code)).alias("codes"))
    return items.join(lists, key, "left").withColumn("codes", F.coalesce("codes", F.array().cast(lists.schema["codes"].dataType)))


def signed(value: Column, digits: int = 2) -> Column:
    """A number with its sign and without trailing zeros: +1.5, -2, +0."""
    v = F.round(value, digits)
    text = F.regexp_replace(F.format_string(f"%.{digits}f", F.abs(v)), r"\.?0+$", "")
    return F.concat(F.when(v < 0, "-").otherwise("+"), text)


def dated_rate(first: Column, last: Column, change: Column) -> Column:
    """Change a month between two dates as texts (4 digits); null if either is no date or they lie too near."""
    months = months_between_dates(F.try_to_date(first, "yyyy-MM-dd"), F.try_to_date(last, "yyyy-MM-dd"))
    return F.round(change / months, 4)
