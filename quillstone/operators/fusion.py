"""Evidence hygiene and weighted reciprocal-rank fusion."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Parts of ids that mark files about a download rather than evidence.
BLOCKED_PARTS = ("download_log", "download_failed", "download_success", "Metadata/summary")
BLOCKED_SUFFIX = "Metadata/summary"


@dataclass(frozen=True)
class FusionWeights:
    k: int = 60
    vector: float = 1.0
    graph: float = 0.8
    boost: float = 0.15
    guideline: float = 1.05
    low_trust: float = 0.5


def blocked(document: Column, chunk: Column) -> Column:
    """Whether an id names housekeeping files."""
    found = document.endswith(BLOCKED_SUFFIX)
    for part in BLOCKED_PARTS:
        found = found | document.contains(part) | chunk.contains(part)
    return F.coalesce(found, F.lit(False))


def canonical_id(document: Column) -> Column:
    """The first PMC number, else the first PMID, else what follows the last slash."""
    return F.coalesce(F.nullif(F.regexp_extract(document, r"PMC\d+", 0), F.lit("")), F.nullif(F.regexp_extract(document, r"PMID_\d+", 0), F.lit("")), F.element_at(F.split(document, "/"), -1))


def rrf(vector: DataFrame, graph: DataFrame, query: str, item: str, weights: FusionWeights = FusionWeights()) -> DataFrame:
    """(query, item, ranks of each side, fused, found_by) from two lists that have ``score`` and, for the graph, ``trust``.

    A list's score for an item is the sum of weight / (k + rank) over its rows for it. Items on both lists get ``boost`` when the
    graph trusts them.
    """

    def side(df: DataFrame, weight: float, name: str) -> DataFrame:
        ranked = df.withColumn("_r", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), F.asc(item))))
        out = [F.sum(F.lit(weight) / (F.lit(weights.k) + F.col("_r"))).alias(f"{name}_part"), F.min("_r").alias(f"{name}_rank"), F.max("score").alias(f"{name}_score")]
        return ranked.groupBy(query, item).agg(*out, *([F.max(F.col("trust") == "high").alias("trusted")] if name == "graph" else []))

    both = side(vector, weights.vector, "vector").join(side(graph, weights.graph, "graph"), [query, item], "full_outer")
    met = F.col("vector_rank").isNotNull() & F.col("graph_rank").isNotNull()
    fused = F.coalesce("vector_part", F.lit(0.0)) + F.coalesce("graph_part", F.lit(0.0)) + F.when(met & F.col("trusted"), F.lit(weights.boost)).otherwise(F.lit(0.0))
    found = F.when(met, "both").when(F.col("vector_rank").isNotNull(), "vector").otherwise("graph")
    return both.select(query, item, "vector_rank", "graph_rank", "vector_score", "graph_score", fused.alias("fused"), found.alias("found_by"))


def favour_guidelines(score: Column, category: Column, weights: FusionWeights = FusionWeights()) -> Column:
    """Guidelines' scores times a factor, rounded to 4 digits; others as they are."""
    return F.when(F.lower(category).contains("guideline"), F.round(score * weights.guideline, 4)).otherwise(score)


def trusted_score(score: Column, trust: Column, weights: FusionWeights = FusionWeights(), unknown: float = 0.5) -> Column:
    """The graph's own score of a hit (``unknown`` without one), lowered for edges of low trust."""
    own = F.coalesce(score, F.lit(unknown))
    return F.when(trust == "low", own * weights.low_trust).otherwise(own)
