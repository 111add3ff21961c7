"""Retrieval queries: vector top-k, caps, fusion with a graph list, canonical documents, budgets."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions.tables import shared_dir, written
from quillstone.operators.fusion import blocked, canonical_id, favour_guidelines, rrf
from quillstone.operators.quantized import ProductIndex, hashed_vectors, spot_check
from quillstone.operators.ranking import category_caps, keep_best, seed_groups, top_n, within_budget
from quillstone.operators.vectors import CellIndex, exact_topk, l2_normalise
from quillstone.plans.catalog import query, table

#: Most chunks of a category that reach fusion, by the stand-in category (label).
CAPS = {"0": 5, "1": 10, "2": 8, "3": 10, "4": 10, "5": 6, "6": 5}
RAW, FINAL = 80, 30

_TOPK = """
  SELECT query_id, item_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM (
    SELECT q.vec_id AS query_id, i.vec_id AS item_id, list_inner_product(q.embedding::DOUBLE[], i.embedding::DOUBLE[]) AS score
    FROM embeddings q, embeddings i WHERE q.vec_id % 20 = 0) QUALIFY rank <= {k}
"""


def _queries(e: DataFrame) -> DataFrame:
    return e.where("vec_id % 20 = 0")


@query(f"SELECT query_id, item_id, round(score, 5) AS score, rank FROM ({_TOPK.format(k=10)})")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return exact_topk(spark, _queries(e), e, 10).select("query_id", "item_id", F.round("score", 5).alias("score"), "rank")


@query(f"""SELECT t.query_id, t.item_id, i.label, t.rank FROM ({_TOPK.format(k=RAW)}) t JOIN embeddings q ON q.vec_id = t.query_id JOIN embeddings i ON i.vec_id = t.item_id
WHERE i.label = q.label""")
def vector_topk_postfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The category filter comes after the limit and may leave fewer rows."""
    e = table(spark, sf_dir, "embeddings")
    hits = exact_topk(spark, _queries(e), e, RAW)
    hits = hits.join(e.select(F.col("vec_id").alias("item_id"), "label"), "item_id").join(_queries(e).select(F.col("vec_id").alias("query_id"), F.col("label").alias("wanted")), "query_id")
    return hits.where("label = wanted").select("query_id", "item_id", "label", "rank")


@query("""SELECT vec_id, pos, round(embedding[pos + 1]::DOUBLE / CASE WHEN n = 0 THEN 1 ELSE n END, 5) AS x FROM
(SELECT vec_id, embedding, unnest(range(len(embedding)))::INT AS pos, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings)""")
def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.posexplode(l2_normalise(F.col("embedding"))).alias("pos", "x")).withColumn("x", F.round("x", 5))


@query(f"""WITH t AS ({_TOPK.format(k=RAW)}),
p AS (SELECT query_id, item_id, score + CASE WHEN item_id % 7 = 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS score, item_id % 7 = 0 AS private FROM t)
SELECT query_id, item_id, private, round(score, 5) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM p) WHERE rank <= {FINAL}""")
def private_blend_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's own hits come with a boost and keep their own ids (each seventh vector stands for one)."""
    e = table(spark, sf_dir, "embeddings")
    hits = exact_topk(spark, _queries(e), e, RAW).drop("rank").withColumn("private", F.col("item_id") % 7 == 0)
    own = hits.where("private").withColumn("score", F.col("score") + 0.5)
    blend = hits.where("not private").unionByName(own)
    return top_n(blend, ["query_id"], [F.desc("score"), F.asc("item_id")], FINAL).select("query_id", "item_id", "private", F.round("score", 5).alias("score"), "rank")


@query()
def ivf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top 10 by the cell-pruned index; its recall is tested against exact search. These vectors hardly cluster: eleven of sixteen cells
    are needed for a recall above 0.9 (eight give 0.896 on sf0.01)."""
    e = table(spark, sf_dir, "embeddings")
    return CellIndex.fit(spark, e, cells=16).search(_queries(e), 10, nprobe=11).select("query_id", "item_id", F.round("score", 5).alias("score"), "rank")


def _word_index(spark: SparkSession, sf_dir: str) -> tuple[ProductIndex, DataFrame]:
    """An index of the documents' word vectors, appended in two slabs, and those vectors."""
    vectors = written(hashed_vectors(table(spark, sf_dir, "documents")), "word-vectors")
    index = ProductIndex.fit(spark, vectors, f"{shared_dir(spark)}/product-index-{uuid.uuid4().hex}", cells=256, id_col="id", vector_col="vector")
    for slab in (0, 1):
        index.append(f"slab-{slab}", vectors.where(F.col("id") % 2 == slab), "id", "vector")
    return index, vectors


@query()
def product_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top 10 of every 20th document among all by product codes (16 bytes a vector and its cell), exactly re-ranked."""
    index, vectors = _word_index(spark, sf_dir)
    hits = index.search(vectors.where("id % 20 = 0"), 10, nprobe=32, again=30, id_col="id", vector_col="vector")
    return hits.select("query_id", "item_id", F.round("score", 5).alias("score"), "rank")


@query(r"SELECT count(*) AS queries, true AS recall_of_nine_tenths FROM documents WHERE doc_id % 20 = 0 AND regexp_matches(text, '[\p{L}\p{N}]')")
def product_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the index finds nine tenths of what exact search does, over the whole query set."""
    index, vectors = _word_index(spark, sf_dir)
    asked = vectors.where("id % 20 = 0")
    exact = exact_topk(spark, asked, vectors, 10, "id", "vector").select("query_id", "item_id")
    checked = spot_check(index, exact, asked, 10, nprobe=32, again=30, id_col="id", vector_col="vector")
    return checked.agg(F.count(F.lit(1)).alias("queries"), (F.avg("recall") >= 0.9).alias("recall_of_nine_tenths"))


_CAPPED = f"""capped AS (
  SELECT query_id, item_id, score, label, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM (
    SELECT t.* EXCLUDE (rank), CAST(i.label AS VARCHAR) AS label, row_number() OVER (PARTITION BY t.query_id, i.label ORDER BY t.score DESC, t.item_id) AS c
    FROM ({_TOPK.format(k=RAW)}) t JOIN embeddings i ON i.vec_id = t.item_id)
  WHERE c <= CASE label {" ".join(f"WHEN '{k}' THEN {v}" for k, v in CAPS.items())} ELSE 30 END QUALIFY rank <= {FINAL})"""


def _capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    hits = exact_topk(spark, _queries(e), e, RAW).drop("rank").join(e.select(F.col("vec_id").alias("item_id"), F.col("label").cast("string").alias("label")), "item_id")
    return category_caps(hits, "query_id", "label", [F.desc("score"), F.asc("item_id")], CAPS, 30, FINAL)


@query(f"WITH {_CAPPED} SELECT query_id, item_id, label, rank FROM capped")
def category_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _capped(spark, sf_dir).select("query_id", "item_id", "label", "rank")


_GRAPH = """graph AS (
  SELECT q.vec_id AS query_id, d.doc_id AS item_id, d.lang, 0.7::DOUBLE AS score, d.rank FROM (SELECT vec_id FROM embeddings WHERE vec_id % 20 = 0) q
  JOIN documents s ON s.doc_id = q.vec_id
  JOIN (SELECT doc_id, source, lang, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank FROM documents JOIN embeddings ON doc_id = vec_id QUALIFY rank <= 20) d ON d.source = s.source)"""


def graph_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document -> its source -> the source's first 20 documents that have a vector."""
    e, d = table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    known = top_n(d.join(e.select(F.col("vec_id").alias("doc_id")), "doc_id"), ["source"], [F.asc("doc_id")], 20)
    seeds = _queries(e).select(F.col("vec_id").alias("query_id")).join(d.select(F.col("doc_id").alias("query_id"), "source"), "query_id")
    return seeds.join(known, "source").select("query_id", F.col("doc_id").alias("item_id"), "lang", F.lit(0.7).alias("score"), "rank")


_FUSED = f"""{_CAPPED}, {_GRAPH}, g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS r FROM graph),
fused AS (SELECT coalesce(v.query_id, g.query_id) AS query_id, coalesce(v.item_id, g.item_id) AS item_id, v.rank AS vector_rank, g.r AS graph_rank,
  coalesce(1.0::DOUBLE / (60 + v.rank), 0.0::DOUBLE) + coalesce(0.8::DOUBLE / (60 + g.r), 0.0::DOUBLE) + CASE WHEN v.rank IS NOT NULL AND g.r IS NOT NULL AND g.lang = 'en' THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END AS fused,
  CASE WHEN v.rank IS NOT NULL AND g.r IS NOT NULL THEN 'both' WHEN v.rank IS NOT NULL THEN 'vector' ELSE 'graph' END AS found_by
  FROM capped v FULL OUTER JOIN g ON v.query_id = g.query_id AND v.item_id = g.item_id)"""


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = graph_pivot(spark, sf_dir).withColumn("trust", F.when(F.col("lang") == "en", "high").otherwise("medium"))
    return rrf(_capped(spark, sf_dir), graph, "query_id", "item_id")


@query(f"WITH {_FUSED} SELECT query_id, item_id, vector_rank, graph_rank, round(fused, 6) AS fused, found_by FROM fused")
def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir).select("query_id", "item_id", "vector_rank", "graph_rank", F.round("fused", 6).alias("fused"), "found_by")


_HYBRID = f"""{_FUSED}, named AS (
  SELECT f.*, CASE WHEN f.item_id % 5 = 0 THEN '' WHEN f.item_id % 5 < 3 THEN 'PMC' || (f.item_id // 3) ELSE 'chapter' || (f.item_id // 4) END AS canonical,
         CASE WHEN i.label = 1 THEN round(f.fused * 1.05::DOUBLE, 4) ELSE f.fused END AS final
  FROM fused f JOIN embeddings i ON i.vec_id = f.item_id),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, canonical ORDER BY final DESC, item_id) AS r FROM named) WHERE r = 1 OR canonical = '')"""


def hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.col("item_id")
    path = F.when(item % 5 == 0, "").when(item % 5 < 3, F.concat(F.lit("lib/PMC"), F.floor(item / 3).cast("string"), F.lit("_a"))).otherwise(F.concat(F.lit("lib/book/chapter"), F.floor(item / 4).cast("string")))
    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), "label")
    category = F.when(F.col("label") == 1, "Clinical guideline").otherwise(F.col("label").cast("string"))
    named = _fused(spark, sf_dir).join(labels, "item_id").withColumn("canonical", canonical_id(path)).withColumn("final", favour_guidelines(F.col("fused"), category))
    return keep_best(named, "query_id", "canonical", [F.desc("final"), F.asc("item_id")])


@query(f"WITH {_HYBRID} SELECT query_id, item_id, canonical, found_by, round(final, 6) AS final, row_number() OVER (PARTITION BY query_id ORDER BY final DESC, item_id) AS rank FROM best QUALIFY rank <= 10")
def hybrid_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector top-k, caps, fusion with the graph's list, guideline factor, one chunk per canonical document, top 10."""
    best = top_n(hybrid(spark, sf_dir), ["query_id"], [F.desc("final"), F.asc("item_id")], 10)
    return best.select("query_id", "item_id", "canonical", "found_by", F.round("final", 6).alias("final"), "rank")


@query(f"""WITH {_FUSED}, s AS (SELECT f.query_id, d.source, min(struct_pack(f := -f.fused, i := f.item_id)) AS best FROM fused f JOIN documents d ON d.doc_id = f.item_id GROUP BY ALL)
SELECT query_id, source, row_number() OVER (PARTITION BY query_id ORDER BY best) AS rank FROM s QUALIFY rank <= 5""")
def seed_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five different sources of each query, best fused score first."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), "source")
    return seed_groups(_fused(spark, sf_dir).join(d, "item_id"), "query_id", "source", [F.desc("fused"), F.asc("item_id")], 5)


@query(f"""WITH {_HYBRID}, r AS (SELECT b.query_id, b.item_id, row_number() OVER (PARTITION BY b.query_id ORDER BY b.final DESC, b.item_id) AS rank, greatest(1, length(d.text) // 4)::BIGINT AS tokens
  FROM best b JOIN documents d ON d.doc_id = b.item_id),
t AS (SELECT *, 150 + sum(tokens) OVER (PARTITION BY query_id ORDER BY rank)::BIGINT AS total FROM r)
SELECT query_id, item_id, rank, tokens, total FROM t WHERE rank <= 10 AND (rank = 1 OR total <= 2500)""")
def context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence packed in rank order until the token budget is full."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.greatest(F.lit(1), F.floor(F.length("text") / 4)).cast("long").alias("tokens"))
    best = top_n(hybrid(spark, sf_dir).join(d, "item_id"), ["query_id"], [F.desc("final"), F.asc("item_id")], 10)
    return within_budget(best, "query_id", "rank", "tokens", 2500, 150).select("query_id", "item_id", "rank", "tokens", "total")


@query(f"""WITH {_HYBRID}, r AS (SELECT b.*, i.label, row_number() OVER (PARTITION BY b.query_id ORDER BY b.final DESC, b.item_id) AS rank FROM best b JOIN embeddings i ON i.vec_id = b.item_id)
SELECT query_id, round(least(1.0::DOUBLE, avg(final) / 0.2::DOUBLE) * 0.6::DOUBLE + least(1.0::DOUBLE, (count(DISTINCT label) + count(DISTINCT found_by)) / 4.0::DOUBLE) * 0.4::DOUBLE, 3) AS confidence,
  CASE WHEN max(fused) >= 0.12 AND count(DISTINCT canonical) >= 2 THEN 'strong' WHEN max(fused) >= 0.03 THEN 'partial' ELSE 'none' END AS coverage FROM r WHERE rank <= 10 GROUP BY query_id""")
def evidence_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean fused score and agreement of categories and origins; coverage class of each query."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), "label")
    best = top_n(hybrid(spark, sf_dir), ["query_id"], [F.desc("final"), F.asc("item_id")], 10).drop("label").join(e, "item_id")
    agreed = F.least(F.lit(1.0), (F.countDistinct("label") + F.countDistinct("found_by")) / 4.0)
    strong = (F.max("fused") >= 0.12) & (F.countDistinct("canonical") >= 2)
    return best.groupBy("query_id").agg(
        F.round(F.least(F.lit(1.0), F.avg("final") / 0.2) * 0.6 + agreed * 0.4, 3).alias("confidence"),
        F.when(strong, "strong").when(F.max("fused") >= 0.03, "partial").otherwise("none").alias("coverage"),
    )


@query("""SELECT doc_id, blocked FROM (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN source || '/download_log' WHEN 1 THEN source || '/Metadata/summary' ELSE source || '/' || doc_id END AS path FROM documents),
LATERAL (SELECT contains(path, 'download_log') OR contains(path, 'download_failed') OR contains(path, 'download_success') OR contains(path, 'Metadata/summary') OR ends_with(path, 'Metadata/summary') AS blocked)""")
def blocklist_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    path = F.concat("source", F.when(F.col("doc_id") % 6 == 0, "/download_log").when(F.col("doc_id") % 6 == 1, "/Metadata/summary").otherwise(F.concat(F.lit("/"), F.col("doc_id").cast("string"))))
    return d.select("doc_id", blocked(path, path).alias("blocked"))
