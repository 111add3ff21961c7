"""Ingest hygiene: duplicates, skip rules, contamination, upserts, integrity counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions.expressions import let
from quillstone.functions.tables import broadcast_if_small, written
from quillstone.operators.dedup import alias_fold, best_by_priority, content_first, first_non_empty, last_wins, settle, unprocessed, upsert
from quillstone.operators.intake import skip_reason
from quillstone.plans.catalog import query, table

@query("SELECT sha256(text) AS hash, min(doc_id) AS original FROM documents GROUP BY 1")
def content_dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_first(table(spark, sf_dir, "documents"), F.col("text"), "doc_id")[0]


@query("SELECT original, doc_id AS duplicate FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS original FROM documents) WHERE doc_id <> original")
def content_dup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_first(table(spark, sf_dir, "documents"), F.col("text"), "doc_id")[1]


_LOG = "SELECT source || '/' || doc_id AS path FROM documents JOIN labels USING (doc_id) WHERE quality = 1"


@query(f"SELECT doc_id, source || '/' || doc_id AS path FROM documents WHERE source || '/' || doc_id NOT IN ({_LOG})")
def processed_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that a processing log (labels: quality 1 is success) doesn't have yet."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"))
    log = d.join(table(spark, sf_dir, "labels"), "doc_id").select("path", F.when(F.col("quality") == 1, "success").otherwise("failed").alias("status"))
    return unprocessed(d, log).select("doc_id", "path")


_PATH = "CASE doc_id % 9 WHEN 0 THEN source || '/blobs/' || doc_id WHEN 1 THEN source || '/.git/' || doc_id || '.txt' WHEN 2 THEN source || '/' || doc_id || '.PY' WHEN 3 THEN source || '/README.' || lang WHEN 4 THEN source || '/config.json' WHEN 5 THEN source || '/summary.json' ELSE source || '/' || doc_id || '.txt' END"


@query(f"""SELECT doc_id, path, CASE WHEN contains(path, '/blobs/') THEN 'skip_huggingface:/blobs/' WHEN contains(path, '/.git/') THEN 'skip_dir:.git' WHEN lower(path) LIKE '%.py' THEN 'skip_extension:.py'
WHEN path LIKE '%/README.%' THEN 'skip_stem:readme' WHEN path LIKE '%/config.json' THEN 'skip_filename:config.json' WHEN path LIKE '%/summary.json' THEN 'skip_review:summary.json' END AS reason
FROM (SELECT doc_id, {_PATH} AS path FROM documents)""")
def skipped_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.expr(_PATH).alias("path"))
    return d.select("doc_id", "path", skip_reason(F.col("path")).alias("reason"))


@query("SELECT d.doc_id, array_to_string(list_sort(list(b.item_id)), ',') AS items FROM documents d JOIN benchmark b ON contains(d.text, b.text) GROUP BY d.doc_id")
def contamination_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a whole benchmark passage: an equi-join on windows of words finds candidates, then containment decides.

    A passage's words but the first and last stand whole in any text that holds it; up to eight of them are its key. Texts
    are read once and their windows meet the passages' keys where they are read, so only hits are shuffled."""
    docs, items = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("passage"))
    w = F.split("passage", " ")
    items = written(items.withColumns({"m": F.least(F.size(w) - 2, F.lit(8)), "key": F.xxhash64(F.array_join(F.slice(w, 2, F.greatest(F.least(F.size(w) - 2, F.lit(8)), F.lit(1))), " "))}), "passages")
    sizes = sorted(r.m for r in items.where("m > 0").select("m").distinct().collect())  # eight at most

    def windows(words: Column) -> Column:
        of = lambda m: F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - m, F.lit(0))), lambda i: F.xxhash64(F.array_join(F.slice(words, i + 1, m), " ")))
        return F.flatten(F.array(*[of(m) for m in sizes]))

    keyed = broadcast_if_small(items.where("m > 0").select("item_id", "passage", "key"), 100_000)
    hits = docs.select("doc_id", "text", F.explode(F.array_distinct(let(F.split("text", " "), windows))).alias("key")).join(keyed, "key").where(F.col("text").contains(F.col("passage"))) if sizes else None
    tiny = items.where("m < 1")  # one or two words: no word is sure to stand whole
    found = [] if hits is None else [hits.select("doc_id", "item_id")]
    if not tiny.isEmpty():
        found.append(docs.join(broadcast_if_small(tiny, 10_000), F.col("text").contains(F.col("passage"))).select("doc_id", "item_id"))
    every = reduce(DataFrame.unionByName, found) if found else docs.where(F.lit(False)).select("doc_id", F.lit(0).cast("long").alias("item_id"))
    return every.distinct().groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_list("item_id")), ",").alias("items"))


@query("SELECT user_id, arg_max(event_id, event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def last_wins_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return last_wins(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value"), "user_id", "event_id")


@query("""SELECT user_id, event_type, value, origin FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY origin DESC, event_id DESC) AS r FROM (
SELECT user_id, event_id, event_type, value, CASE WHEN event_type = 'click' THEN 'new' ELSE 'old' END AS origin FROM events) WHERE origin = 'new' OR user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'click'))
WHERE origin = 'old' OR r = 1""")
def node_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks upserted by user into the other events."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    old, new = e.where("event_type <> 'click'").withColumn("origin", F.lit("old")), e.where("event_type = 'click'").withColumn("origin", F.lit("new"))
    return upsert(old, new, "user_id", "event_id").select("user_id", "event_type", "value", "origin")


@query("SELECT l_partkey, l_orderkey, l_linenumber, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_quantity DESC, l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r = 1")
def priority_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per part the line of the highest quantity, the first of equals."""
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_quantity").withColumn("ord", F.struct("l_orderkey", "l_linenumber"))
    return best_by_priority(li, "l_partkey", "l_quantity", "ord").drop("ord")


@query("""SELECT l_suppkey, min_by(l_shipdate::VARCHAR, l_orderkey * 10 + l_linenumber) FILTER (l_returnflag = 'R') AS returned, min_by(l_linestatus, l_orderkey * 10 + l_linenumber) FILTER (l_linestatus <> '') AS status
FROM lineitem GROUP BY l_suppkey""")
def first_non_empty_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    shipped = F.when(F.col("l_returnflag") == "R", F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss")).otherwise("")
    rows = li.select("l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), shipped.alias("returned"), F.col("l_linestatus").alias("status"))
    return first_non_empty(rows, "l_suppkey", "ord", ["returned", "status"])


@query("""WITH r AS (SELECT p_brand, p_type, p_partkey AS o, max(row(p_size % 5, -p_partkey, p_type)) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS now FROM part),
a AS (SELECT p_brand, p_type, min(o) AS o FROM r WHERE p_type <> now[3] GROUP BY ALL)
SELECT b.p_brand, b.term, coalesce(x.aliases, '') AS aliases FROM (SELECT p_brand, arg_max(p_type, (p_size % 5, -p_partkey)) AS term FROM part GROUP BY p_brand) b
LEFT JOIN (SELECT p_brand, string_agg(p_type, ',' ORDER BY o) AS aliases FROM a GROUP BY p_brand) x USING (p_brand)""")
def alias_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as concepts, part types as their strings, sizes as priorities."""
    p = table(spark, sf_dir, "part").select("p_brand", "p_type", (F.col("p_size") % 5).cast("int").alias("priority"), F.col("p_partkey").alias("ord"))
    return alias_fold(p, "p_brand", "p_type", "priority", "ord").withColumn("aliases", F.array_join("aliases", ","))


@query()
def document_dedup_hash_or_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as documents with a hash and an id that clash."""
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select(k.alias("ord"), (k * 7919 % 400_001).alias("hash"), (k * 104_729 % 500_003).alias("id"))
    return settle(o, "hash", "id", "ord").select("ord")


@query("""SELECT (SELECT count(*) FROM documents) AS n, (SELECT min(doc_id) FROM documents) AS low, (SELECT max(doc_id) FROM documents) AS high, (SELECT count(DISTINCT doc_id) FROM documents) AS ids,
(SELECT count(*) - count(text) FROM documents) AS null_texts, (SELECT count(*) - count(DISTINCT sha256(text)) FROM documents) AS repeated_texts""")
def integrity_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = table(spark, sf_dir, "documents").select("doc_id", "text", F.sha2("text", 256).alias("h"))
    return hashed.agg(
        F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count_distinct("doc_id").alias("ids"),
        F.count_if(F.col("text").isNull()).alias("null_texts"), (F.count(F.lit(1)) - F.count_distinct("h")).alias("repeated_texts"),
    )


@query("""SELECT source, count(*) FILTER (quality = 1) AS success, count(*) FILTER (quality = 0) AS failed, count(*) FILTER (quality IS NULL) AS pending FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""")
def folder_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return d.groupBy("source").agg(F.count_if(F.col("quality") == 1).alias("success"), F.count_if(F.col("quality") == 0).alias("failed"), F.count_if(F.col("quality").isNull()).alias("pending"))


@query("SELECT lang, count(*) AS n, count(*) FILTER (n_chars > 2000) AS long_texts FROM documents GROUP BY lang")
def format_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("n_chars") > 2000).alias("long_texts"))


@query("""SELECT doc_id, CASE WHEN coalesce(lang, 'en') <> 'en' THEN 'none' WHEN source IN ('src0', 'src1') THEN 'both' WHEN source = 'src2' AND length(text) > 200 THEN 'both' WHEN source = 'src2' THEN 'graph' ELSE 'faiss' END AS target
FROM documents""")
def route_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which index a document goes to, by source (as category), language and length."""
    d = table(spark, sf_dir, "documents")
    graph = F.col("source") == "src2"
    target = F.when(F.coalesce("lang", F.lit("en")) != "en", "none").when(F.col("source").isin("src0", "src1"), "both").when(graph & (F.length("text") > 200), "both").when(graph, "graph").otherwise("faiss")
    return d.select("doc_id", target.alias("target"))
