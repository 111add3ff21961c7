"""The operators as queries over the given tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import sql
from quillstone.llm.bpe import bpe_encode
from quillstone.llm.centroids import clustered
from quillstone.llm.embedding_dedup import embedding_near_dedup
from quillstone.llm.html_extract import extract_main_text
from quillstone.llm.license_scan import license_scan
from quillstone.llm.merkle import verified_manifest
from quillstone.llm.minhash_dedup import minhash_near_dedup
from quillstone.llm.mixing import mix_counts
from quillstone.llm.pii import personal_data
from quillstone.llm.quality import quality_rules
from quillstone.llm.secret_scan import secret_scan
from quillstone.llm.toxicity import toxicity
from quillstone.llm.url_filters import stated_rules, url_filter


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where a public tokenizer's file is."""
    return public_tokenizers.path(name)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_near_dedup(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_near_dedup(spark, _documents(spark, sf_dir))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(spark, _documents(spark, sf_dir))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of the directories source/lang."""
    docs = _documents(spark, sf_dir)
    parts = [F.coalesce("source", F.lit("unknown")), F.coalesce("lang", F.lit("unknown")), F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))]
    return license_scan(spark, docs.withColumn("path", F.concat_ws("/", *parts)))


def op5_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = extract_main_text(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return pages.withColumn("n_chars", F.length("text").cast("long"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    findings, _ = secret_scan(spark, _documents(spark, sf_dir))
    return findings.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe_encode(spark, _documents(spark, sf_dir), tokenizer_path())
    return coded.select("doc_id", "n_tokens", F.sha2(F.col("ids").cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_counts(spark, _documents(spark, sf_dir))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(_documents(spark, sf_dir))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(spark, _documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"), *stated_rules(spark))


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verified_manifest(spark, _documents(spark, sf_dir))


QUERIES = (
    op1_embedding_near_dedup, op2_minhash_near_dedup, op3_quality_rules, op4_license_scan, op5_html_main_text, op6_secret_scan, op7_bpe,
    op8_mix_sources, op9_personal_data, op10_toxicity, op11_url_filters, op12_centroid_clusters, op13_merkle_manifest,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_embedding_near_dedup": sql.OP1, "op2_minhash_near_dedup": sql.OP2, "op3_quality_rules": sql.OP3, "op8_mix_sources": sql.OP8,
        "op11_url_filters": sql.OP11, "op12_centroid_clusters": sql.OP12, "op13_merkle_manifest": sql.OP13,
    }
