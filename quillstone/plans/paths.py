"""Typed paths over orders as documents, lines as chunks, parts as diseases, suppliers as tests, customers as drugs and regions as terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions.tables import written
from quillstone.operators.containment import contains_join
from quillstone.operators.graph import STOPWORDS, query_terms
from quillstone.operators.paths import Hop, chunk_heads, entity_chunks, own_chunks, passes, seeded_hits, seeded_only, seeded_ranks, seeds, shared_entities, tested_entities
from quillstone.operators.ranking import top_n
from quillstone.plans.catalog import query, table


def _graph(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    li, o, p, s, c, n, r = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "part", "supplier", "customer", "nation", "region"))
    named = lambda df, k, v: df.select(F.col(k).alias("entity"), F.col(v).alias("name"))
    region = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), F.col("n_regionkey").alias("dst"))
    treats = F.when(F.col("l_returnflag") == "R", "DRUG_CAUSES").otherwise("DRUG_TREATS")
    return {
        "parts": named(p, "p_partkey", "p_name"), "tests": named(s, "s_suppkey", "s_name"), "drugs": named(c, "c_custkey", "c_name"), "terms": named(r, "r_regionkey", "r_name"),
        "mentions": li.select(F.col("l_partkey").alias("entity"), F.col("l_orderkey").alias("document"), F.lit("DOCUMENT_MENTIONS").alias("kind")),
        "chunks": li.select(F.col("l_orderkey").alias("document"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("chunk")),
        "tested": li.select(F.col("l_orderkey").alias("document"), F.col("l_suppkey").alias("entity")),
        "related": li.select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.lit("LABTEST_RELATED_TO").alias("kind")).distinct(),
        "treats": li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("src"), F.col("l_partkey").alias("dst"), treats.alias("kind")).distinct(),
        "mapped": li.select("l_partkey", "l_suppkey").distinct().join(region, "l_suppkey").select(F.col("l_partkey").alias("src"), "dst", F.lit("DISEASE_MAPPED_TO").alias("kind")).distinct(),
    }


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 20th order asks in words for its first line's part and supplier, its customer and the supplier's region."""
    li, o, p, s, c, n, r = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "part", "supplier", "customer", "nation", "region"))
    first = li.where("l_orderkey % 20 = 0").groupBy("l_orderkey").agg(F.min(F.struct("l_linenumber", "l_partkey", "l_suppkey")).alias("f")).select("l_orderkey", "f.l_partkey", "f.l_suppkey")
    rows = first.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(p, F.col("l_partkey") == F.col("p_partkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    rows = rows.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    said = F.concat(F.lit("What is the risk of "), "p_name", F.lit(" by "), "s_name", F.lit(" for "), "c_name", F.lit(" in "), "r_name", F.lit("?"))
    return rows.select(F.col("l_orderkey").alias("query"), said.alias("question"))


_NAMES = """names AS (SELECT 0 AS l, 'Disease' AS label, p_partkey AS e, p_name AS name FROM part UNION ALL SELECT 1, 'LabTest', s_suppkey, s_name FROM supplier
  UNION ALL SELECT 2, 'Drug', c_custkey, c_name FROM customer UNION ALL SELECT 3, 'OntologyTerm', r_regionkey, r_name FROM region)"""
_ASKED = f"""fl AS (SELECT l_orderkey, min({{'n': l_linenumber, 'p': l_partkey, 's': l_suppkey}}) AS f FROM lineitem WHERE l_orderkey % 20 = 0 GROUP BY l_orderkey),
q AS (SELECT l_orderkey AS query, 'What is the risk of ' || p_name || ' by ' || s_name || ' for ' || c_name || ' in ' || r_name || '?' AS question FROM fl JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = f.p
  JOIN supplier ON s_suppkey = f.s JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey),
qw AS (SELECT query, list_filter(list_transform(list_filter(regexp_split_to_array(question, '[^\\p{{L}}\\p{{N}}_]+'), lambda x: regexp_matches(x, '^[a-zA-Z0-9]{{3,}}$')), lambda x: lower(x)), lambda x: x NOT IN ({", ".join(f"'{x}'" for x in STOPWORDS)})) AS w FROM q),
qa AS (SELECT query, list_concat(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), w) AS t FROM qw),
qo AS (SELECT query, term, min(i) AS ord FROM (SELECT query, unnest(t) AS term, unnest(range(1, len(t) + 1)) AS i FROM qa) GROUP BY ALL)"""
#: The first six (through, document, chunk) of each entity of each label.
_HITS = """li AS (SELECT DISTINCT l_partkey AS p, l_orderkey AS d FROM lineitem), ch AS (SELECT l_orderkey AS d, l_orderkey * 10 + l_linenumber AS c FROM lineitem GROUP BY ALL),
hp AS (SELECT p, d, c, row_number() OVER (PARTITION BY p ORDER BY d, c) AS n FROM li JOIN ch USING (d) QUALIFY n <= 6),
via AS (SELECT 1 AS l, l_suppkey AS e, l_partkey AS v, 'LABTEST_RELATED_TO' AS kind FROM lineitem GROUP BY ALL
  UNION ALL SELECT 2, o_custkey, l_partkey, min(CASE l_returnflag WHEN 'R' THEN 'DRUG_CAUSES' ELSE 'DRUG_TREATS' END) FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL
  UNION ALL SELECT DISTINCT 3, n_regionkey, l_partkey, 'DISEASE_MAPPED_TO' FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey),
v6 AS (SELECT * FROM via QUALIFY row_number() OVER (PARTITION BY l, e ORDER BY v) <= 6),
hv AS (SELECT * FROM (SELECT l, e, v, kind, d, c, row_number() OVER (PARTITION BY l, e ORDER BY v, d, c) AS n FROM v6 JOIN hp ON p = v) WHERE n <= 6),
hit AS (SELECT 0 AS l, p AS e, n, d, c, 'DOCUMENT_MENTIONS>HAS_CHUNK' AS path, 'Disease:' || p || ':' || name AS ents, 'Disease(' || name || ') -[DOCUMENT_MENTIONS]-> Document(' || d || ') -[HAS_CHUNK]-> Chunk(' || c || ')' AS text
  FROM hp JOIN names x ON x.l = 0 AND x.e = p
  UNION ALL SELECT h.l, h.e, n, d, c, kind || '>DOCUMENT_MENTIONS>HAS_CHUNK', x.label || ':' || h.e || ':' || x.name || '|Disease:' || v || ':' || y.name,
  x.label || '(' || x.name || ')' || CASE h.l WHEN 3 THEN ' <-[' ELSE ' -[' END || kind || CASE h.l WHEN 3 THEN ']- ' ELSE ']-> ' END || 'Disease(' || y.name || ') -[DOCUMENT_MENTIONS]-> Document(' || d || ') -[HAS_CHUNK]-> Chunk(' || c || ')'
  FROM hv h JOIN names x ON x.l = h.l AND x.e = h.e JOIN names y ON y.l = 0 AND y.e = v)"""
_FOUND = f"""{_NAMES}, {_ASKED}, {_HITS},
sd AS (SELECT term, l, label, e, row_number() OVER (PARTITION BY term, l ORDER BY e) AS place FROM (SELECT DISTINCT term FROM qo) JOIN names ON contains(lower(name), term) QUALIFY place <= 3),
f0 AS (SELECT query, ord, term, s.l, label, place, h.* EXCLUDE (l, e) FROM qo JOIN sd s USING (term) JOIN hit h ON h.l = s.l AND h.e = s.e QUALIFY row_number() OVER (PARTITION BY query, c ORDER BY ord, s.l, place, n) = 1),
seeded AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY ord, l, place, n) AS rank FROM f0 QUALIFY rank <= 20)"""


def _hits(g: dict[str, DataFrame], heads: DataFrame) -> DataFrame:
    """Hits of the entities of the four labels, tests through their relation, drugs through treats or causes, terms against their mapping."""
    out = entity_chunks(heads, "Disease", g["seeded Disease"]).withColumn("label", F.lit("Disease"))
    for label, edges, back in (("LabTest", "related", False), ("Drug", "treats", False), ("OntologyTerm", "mapped", True)):
        out = out.unionByName(entity_chunks(heads, label, g[f"seeded {label}"], Hop(g[edges], "Disease", g["parts"], back)).withColumn("label", F.lit(label)))
    return out


def _seeded(spark: SparkSession, sf_dir: str, all_tests: bool = False) -> tuple[dict[str, DataFrame], DataFrame, DataFrame, tuple[DataFrame, DataFrame]]:
    """The graph, the first chunks of its diseases, the questions' terms, and what ``seeded_hits`` takes besides: seeds and
    hits of the entities that a term seeds (and of all tests)."""
    g = _graph(spark, sf_dir)
    terms = written(_questions(spark, sf_dir).select("query", F.posexplode(query_terms(F.col("question"))).alias("ord", "term")), "terms")
    labels = [("Disease", g["parts"]), ("LabTest", g["tests"]), ("Drug", g["drugs"]), ("OntologyTerm", g["terms"])]
    found = written(seeds(terms, labels), "seeds")
    heads = written(chunk_heads(g["mentions"], g["chunks"]), "heads")
    for label, names in labels:
        g[f"seeded {label}"] = names if all_tests and label == "LabTest" else seeded_only(names, found, label)
    return g, heads, terms, (found, written(_hits(g, heads), "hits"))


def _plain(df: DataFrame) -> DataFrame:
    """Paths and entities as texts."""
    ents = F.array_join(F.transform("entities", lambda x: F.concat_ws(":", x["label"], x["id"], x["name"])), "|")
    return df.withColumns({"path": F.array_join("path", ">"), "entities": ents})


@query(f"WITH {_FOUND} SELECT query, rank, term, label, d AS document, c AS chunk, path, ents AS entities, text, 0.85::DOUBLE AS score, 'high' AS trust FROM seeded")
def seeded_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of four labels that a question's terms name, and the chunks they lead to, with path, entities and score."""
    _, _, terms, (found, hits) = _seeded(spark, sf_dir)
    return _plain(seeded_hits(terms, found, hits, 20))


@query(f"""WITH {_FOUND}, docs AS (SELECT o_orderkey AS query, 1 AS place, o_orderkey AS d FROM orders WHERE o_orderkey % 20 = 0
  UNION ALL SELECT a.o_orderkey, 1 + row_number() OVER (PARTITION BY a.o_orderkey ORDER BY b.o_orderkey), b.o_orderkey FROM orders a JOIN orders b ON b.o_custkey = a.o_custkey AND b.o_orderkey <> a.o_orderkey WHERE a.o_orderkey % 20 = 0
  QUALIFY row_number() OVER (PARTITION BY a.o_orderkey ORDER BY b.o_orderkey) <= 4),
o0 AS (SELECT ch.d, c, p, row_number() OVER (PARTITION BY ch.d ORDER BY c, p) AS n FROM ch LEFT JOIN li ON li.d = ch.d QUALIFY n <= 6),
own AS (SELECT query, place, n, x.d, c, 'HAS_CHUNK' AS path, coalesce('Disease:' || p || ':' || name, '') AS ents, coalesce('Disease(' || name || ') <-[DOCUMENT_MENTIONS]- ', '') || 'Document(' || x.d || ') -[HAS_CHUNK]-> Chunk(' || c || ')' AS text, 0.85::DOUBLE AS score
  FROM docs x JOIN (SELECT * FROM o0 QUALIFY row_number() OVER (PARTITION BY d, c ORDER BY n) = 1) o ON o.d = x.d LEFT JOIN names y ON y.l = 0 AND y.e = p),
e0 AS (SELECT d, p, row_number() OVER (PARTITION BY d ORDER BY p) AS k FROM li QUALIFY k <= 10),
shared AS (SELECT query, place, k * 1000 + n AS n, hp.d, c, 'DOCUMENT_MENTIONS>HAS_CHUNK' AS path, 'Disease:' || e0.p || ':' || name AS ents, NULL AS text, 0.70::DOUBLE AS score FROM docs x JOIN e0 ON e0.d = x.d JOIN hp ON hp.p = e0.p JOIN names y ON y.l = 0 AND y.e = e0.p),
t0 AS (SELECT d, s, row_number() OVER (PARTITION BY d ORDER BY s) AS k FROM (SELECT DISTINCT l_orderkey AS d, l_suppkey AS s FROM lineitem) QUALIFY k <= 5),
tested AS (SELECT query, place, k * 1000 + n AS n, h.d, c, kind || '>DOCUMENT_MENTIONS>HAS_CHUNK' AS path, 'LabTest:' || s || ':' || name AS ents, NULL AS text, 0.75::DOUBLE AS score FROM docs x JOIN t0 ON t0.d = x.d JOIN hv h ON h.l = 1 AND h.e = s JOIN names y ON y.l = 1 AND y.e = s WHERE place <= 3),
u AS (SELECT query, 0 AS pass, 0 AS place, rank AS n, d, c, path, ents, text, 0.85::DOUBLE AS score FROM seeded WHERE rank <= 6 UNION ALL SELECT query, 1, place, n, d, c, path, ents, text, score FROM own UNION ALL SELECT query, 2, place, n, d, c, path, ents, text, score FROM shared
  UNION ALL SELECT query, 3, place, n, d, c, path, ents, text, score FROM tested),
once AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY query, c ORDER BY pass, place, n) = 1)
SELECT query, row_number() OVER (PARTITION BY query ORDER BY pass, place, n) AS rank, pass, d AS document, c AS chunk, path, ents AS entities, text, score, 'high' AS trust FROM once QUALIFY rank <= 20""")
def typed_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named entities first (six hits here, so that every pass shows), then the documents' own chunks, those that share an
    entity and those reached through tests. Seeds are the order and its customer's first four others."""
    g, heads, terms, (found, hits) = _seeded(spark, sf_dir, all_tests=True)
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    mine = o.where("o_orderkey % 20 = 0")
    other = mine.join(o.select("o_custkey", F.col("o_orderkey").alias("document")), "o_custkey").where("document <> o_orderkey")
    other = top_n(other, ["o_orderkey"], [F.asc("document")], 4, "_r").select(F.col("o_orderkey").alias("query"), (F.col("_r") + 1).alias("place"), "document")
    docs = written(mine.select(F.col("o_orderkey").alias("query"), F.lit(1).alias("place"), F.col("o_orderkey").alias("document")).unionByName(other), "seed-docs")
    own = lambda d: own_chunks(d, g["chunks"], g["mentions"], g["parts"], "Disease")
    shared = lambda d: shared_entities(d, g["mentions"], heads, g["parts"], "Disease")
    tests = lambda d: tested_entities(d, g["tested"], hits.where("label = 'LabTest'"), g["tests"], "LabTest")
    return _plain(passes(seeded_ranks(terms, found, hits, 6), docs, own, shared, tests))


@query("""WITH n AS (SELECT DISTINCT lower(p_name) AS name FROM part), t AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{2,5}')) AS term FROM benchmark)
SELECT t.term, n.name FROM t JOIN n ON contains(n.name, t.term)""")
def contained_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short runs of letters of benchmark passages inside the names of parts."""
    terms = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{2,5}"), F.lit(0))).alias("term")).distinct()
    return contains_join(terms, table(spark, sf_dir, "part").select(F.lower("p_name").alias("name")).distinct(), "term", "name")
