"""A corpus pipeline of five of the operators, each stage over all that its predecessor kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.bpe import bpe_encode
from quillstone.llm.minhash_dedup import minhash_near_dedup
from quillstone.llm.mixing import mixed_documents
from quillstone.llm.registry import tokenizer_path
from quillstone.llm.secret_scan import redact, secret_scan
from quillstone.llm.shared import Stage, as_struct, broadcast_if_small, from_struct, shared_dir
from quillstone.llm.toxicity import toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't call toxic; null ids are kept."""
    rows = as_struct(docs, F.col("doc_id"), F.col("text"))
    scored = toxicity(spark, rows, spark.read.parquet(f"{sf_dir}/labels.parquet"), keep=["_d"])
    return from_struct(scored.where("predicted = 0"), docs, {})


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the smallest id (nulls last).

    Rows are numbered and compared by their numbers, so one that repeats another's id goes for its own text only."""
    stage = Stage(spark, "near-copies")
    rows = stage.cut(as_struct(docs, F.monotonically_increasing_id().alias("_row")), "rows")
    found = minhash_near_dedup(spark, rows.select("_row", F.col("_d.text").alias("text")), id_col="_row")
    ids = rows.select("_row", F.col("_d.doc_id").alias("_id"))
    of_row = stage.cut(found.select("_row", F.col("component_id").alias("_component")).join(ids, "_row"), "components")
    first = of_row.groupBy("_component").agg(F.min(F.struct(F.col("_id").isNull(), "_id", "_row")).alias("_first"), F.count(F.lit(1)).alias("_n"))
    first = stage.cut(first.where("_n > 1").select("_component", F.col("_first._row").alias("_kept")), "first")  # a row per group
    gone = of_row.join(broadcast_if_small(first, first.count()), "_component").where("_row <> _kept").select("_row")
    gone = stage.cut(gone, "gone")
    kept = rows.join(broadcast_if_small(gone, gone.count()), "_row", "left_anti")
    return from_struct(kept, docs, {})


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret found replaced."""
    findings, _ = secret_scan(spark, docs)
    return redact(spark, docs, findings)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them."""
    return mixed_documents(spark, docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row (comma-joined decimals), by document and source."""
    return bpe_encode(spark, docs, tokenizer_path(), keep=["source"]).select("doc_id", "source", "n_tokens", "ids")


STAGES = [("toxicity", drop_toxic), ("minhash_near_dedup", drop_near_copies), ("secret_scan", redact_secrets), ("mix_sources", mix_sources), ("bpe", encode)]
#: SQL can express none of a trained classifier, MinHash and BPE; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; each result is written to the shared folder and read again."""
    docs, root = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
    return docs
