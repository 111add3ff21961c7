"""Graph queries over orders, lines, parts, suppliers, customers and nations as a property graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.functions.tables import broadcast_if_small
from quillstone.operators.graph import expand, first_nodes, limited, linked_edges, merge_passes, query_terms
from quillstone.operators.ranking import top_n
from quillstone.plans.catalog import query, table
from quillstone.plans.texts import _TERMS


def _edges(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    line = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("dst")
    return {
        "has_line": li.select(F.col("l_orderkey").alias("src"), line),
        "mentions": li.select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst")),
        "supplied": li.select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")),
        "ordered_by": o.select(F.col("o_orderkey").alias("src"), F.col("o_custkey").alias("dst")),
    }


def _back(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


_SEEDS = "SELECT p_partkey AS q FROM part WHERE p_partkey % 20 = 0"


def _seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where("p_partkey % 20 = 0").select(F.col("p_partkey").alias("query_id"), F.col("p_partkey").alias("node"))


_TWO = f"SELECT DISTINCT q.q AS query_id, c.l_orderkey * 10 + c.l_linenumber AS node FROM ({_SEEDS}) q JOIN lineitem m ON m.l_partkey = q.q JOIN lineitem c ON c.l_orderkey = m.l_orderkey"


@query(f"SELECT query_id, node, row_number() OVER (PARTITION BY query_id ORDER BY node) AS ord FROM ({_TWO}) QUALIFY ord <= 6")
def two_hop_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part <- order -> lines, six lines a part."""
    e = _edges(spark, sf_dir)
    return first_nodes(_seeds(spark, sf_dir), _back(e["mentions"]), e["has_line"], n=6)


@query("""SELECT query_id, node, row_number() OVER (PARTITION BY query_id ORDER BY node) AS ord FROM (SELECT DISTINCT s.s_suppkey AS query_id, c.l_orderkey * 10 + c.l_linenumber AS node
FROM supplier s JOIN lineitem p ON p.l_suppkey = s.s_suppkey AND p.l_returnflag IN ('R', 'A') JOIN lineitem m ON m.l_partkey = p.l_partkey
JOIN lineitem c ON c.l_orderkey = m.l_orderkey WHERE s.s_suppkey % 20 = 0) QUALIFY ord <= 6""")
def three_hop_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier -[returned or accepted]-> part <- order -> lines: two kinds of edges in the first hop."""
    li = table(spark, sf_dir, "lineitem")
    kind = lambda flag: li.where(F.col("l_returnflag") == flag).select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"))
    first = kind("R").unionByName(kind("A"))
    orders = li.select(F.col("l_partkey").alias("src"), F.col("l_orderkey").alias("dst"))
    seeds = table(spark, sf_dir, "supplier").where("s_suppkey % 20 = 0").select(F.col("s_suppkey").alias("query_id"), F.col("s_suppkey").alias("node"))
    return first_nodes(seeds, first, orders, _edges(spark, sf_dir)["has_line"], n=6)


@query("SELECT c_custkey AS customer, count(o_orderkey) AS orders, min(o_orderkey) AS first_order FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 200000 GROUP BY c_custkey")
def optional_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").where("o_totalprice > 200000")
    return c.join(o, F.col("o_custkey") == F.col("c_custkey"), "left").groupBy(F.col("c_custkey").alias("customer")).agg(F.count("o_orderkey").alias("orders"), F.min("o_orderkey").alias("first_order"))


_PIVOT = """pivoted AS (SELECT o.o_orderkey AS query_id, m.l_partkey AS part, row_number() OVER (PARTITION BY o.o_orderkey ORDER BY m.l_partkey) AS r FROM orders o
  JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) m ON m.l_orderkey = o.o_orderkey WHERE o.o_orderkey % 20 = 0 QUALIFY r <= 10),
near AS (SELECT p.query_id, l.l_orderkey AS node, row_number() OVER (PARTITION BY p.query_id, p.part ORDER BY l.l_orderkey) AS k FROM pivoted p
  JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) l ON l.l_partkey = p.part AND l.l_orderkey <> p.query_id QUALIFY k <= 6),
other AS (SELECT query_id, node, row_number() OVER (PARTITION BY query_id ORDER BY node) AS ord FROM (SELECT DISTINCT query_id, node FROM near))"""


def _pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six orders of each part are cut out before any seed meets them (seven, as one may be the seed itself)."""
    mentions = _edges(spark, sf_dir)["mentions"].distinct()
    seeds = table(spark, sf_dir, "orders").where("o_orderkey % 20 = 0").select(F.col("o_orderkey").alias("query_id"), F.col("o_orderkey").alias("node"))
    parts = limited(expand(seeds, mentions).select("query_id", "node"), 10, "query_id").select("query_id", F.col("node").alias("dst"))
    of_part = top_n(mentions, ["dst"], [F.asc("src")], 7, "_k").select("dst", F.col("src").alias("node"))
    near = top_n(parts.join(of_part, "dst").where("node <> query_id"), ["query_id", "dst"], [F.asc("node")], 6, "_k")
    return near.select("query_id", "node").distinct().withColumn("ord", F.row_number().over(Window.partitionBy("query_id").orderBy("node")))


@query(f"WITH {_PIVOT} SELECT query_id, node, ord FROM other")
def entity_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order -> its first ten parts -> the first six other orders of each of them."""
    return _pivot(spark, sf_dir)


@query(f"""WITH {_PIVOT}, own AS (SELECT l_orderkey AS query_id, l_orderkey AS node, 1::BIGINT AS ord, 0 AS pass, 0.85::DOUBLE AS score FROM lineitem WHERE l_orderkey % 20 = 0 GROUP BY l_orderkey),
customer_ AS (SELECT a.o_orderkey AS query_id, b.o_orderkey AS node, row_number() OVER (PARTITION BY a.o_orderkey ORDER BY b.o_orderkey) AS ord FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey WHERE a.o_orderkey % 20 = 0 QUALIFY ord <= 6),
u AS (SELECT * FROM own UNION ALL SELECT query_id, node, ord, 1, 0.70::DOUBLE FROM other UNION ALL SELECT query_id, node, ord, 2, 0.75::DOUBLE FROM customer_),
d AS (SELECT *, row_number() OVER (PARTITION BY query_id, node ORDER BY pass, ord) AS one FROM u QUALIFY one = 1)
SELECT query_id, node, pass, score, row_number() OVER (PARTITION BY query_id ORDER BY pass, ord, node) AS rank FROM d QUALIFY rank <= 20""")
def traversal_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document itself, the pivot through its entities, then through its customer; each node once, twenty a query."""
    e = _edges(spark, sf_dir)
    own = e["has_line"].where("src % 20 = 0").select(F.col("src").alias("query_id"), F.col("src").alias("node")).distinct().withColumn("ord", F.lit(1))
    seeds = table(spark, sf_dir, "orders").where("o_orderkey % 20 = 0").select(F.col("o_orderkey").alias("query_id"), F.col("o_orderkey").alias("node"))
    by_customer = limited(expand(seeds, e["ordered_by"], _back(e["ordered_by"])).select("query_id", "node"), 6, "query_id")
    return merge_passes([(own, 0.85), (_pivot(spark, sf_dir), 0.70), (by_customer, 0.75)], limit=20).select("query_id", "node", "pass", "score", "rank")


@query("""SELECT l_orderkey AS src, l_partkey AS dst, count(*) AS n FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size <= 25) AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY ALL""")
def edge_bag_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions whose ends are both there, counted as the bag they are."""
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"))
    parts = table(spark, sf_dir, "part").where("p_size <= 25").select(F.col("p_partkey").alias("id"))
    return linked_edges(_edges(spark, sf_dir)["mentions"], orders, parts).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT 'orders' AS name, count(*) AS n FROM orders UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'supplier', count(*) FROM supplier UNION ALL SELECT 'mentions', count(*) FROM lineitem UNION ALL SELECT 'ordered_by', count(*) FROM orders""")
def graph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _edges(spark, sf_dir)
    counted = [table(spark, sf_dir, t).select(F.lit(t).alias("name")) for t in ("orders", "part", "supplier")] + [e[k].select(F.lit(k).alias("name")) for k in ("mentions", "ordered_by")]
    out = counted[0]
    for d in counted[1:]:
        out = out.unionByName(d)
    return out.groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT round(100.0::DOUBLE * count(DISTINCT l_partkey) / (SELECT count(*) FROM part), 2) AS parts_pct, round(100.0::DOUBLE * count(DISTINCT l_suppkey) / (SELECT count(*) FROM supplier), 2) AS suppliers_pct FROM lineitem WHERE l_returnflag = 'R'""")
def coverage_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    n = lambda t, c: table(spark, sf_dir, t).agg(F.count(F.lit(1)).alias(c))
    one = li.agg(F.count_distinct("l_partkey").alias("p"), F.count_distinct("l_suppkey").alias("s")).join(F.broadcast(n("part", "np"))).join(F.broadcast(n("supplier", "ns")))
    return one.select(F.round(100.0 * F.col("p") / F.col("np"), 2).alias("parts_pct"), F.round(100.0 * F.col("s") / F.col("ns"), 2).alias("suppliers_pct"))


@query("""SELECT n_name, r_name, count(DISTINCT c_custkey) AS customers, count(o_orderkey) AS orders FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN orders ON o_custkey = c_custkey GROUP BY n_name, r_name""")
def path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n, r, o = (table(spark, sf_dir, t) for t in ("customer", "nation", "region", "orders"))
    per = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("k"))
    joined = c.join(per, "c_custkey").join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("n_name", "r_name").agg(F.count(F.lit(1)).alias("customers"), F.sum("k").alias("orders"))


@query("""SELECT s_suppkey, s_name, code FROM supplier LEFT JOIN (SELECT c_nationkey, max_by(c_custkey, c_custkey) AS code FROM customer GROUP BY c_nationkey) ON s_nationkey = c_nationkey""")
def left_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lookup whose build side keeps the last row of a key."""
    last = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.max("c_custkey").alias("code"))
    return table(spark, sf_dir, "supplier").join(last, F.col("s_nationkey") == F.col("c_nationkey"), "left").select("s_suppkey", "s_name", "code")


@query("SELECT p_type, array_to_string(list_sort(list(DISTINCT p_brand)), ',') AS brands, count(*) AS n FROM part GROUP BY p_type")
def group_collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy("p_type").agg(F.array_join(F.array_sort(F.collect_set("p_brand")), ",").alias("brands"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_TERMS}, u AS (SELECT conv_id, turn, term, min(n) AS ord FROM (SELECT conv_id, turn, unnest(list_distinct(t)) AS term, 0 AS n FROM terms) GROUP BY ALL),
o AS (SELECT u.conv_id, u.turn, u.term, list_position(terms.t, u.term) AS ord FROM u JOIN terms ON u.conv_id = terms.conv_id AND u.turn = terms.turn),
h AS (SELECT o.*, b.item_id, row_number() OVER (PARTITION BY o.conv_id, o.turn, o.term ORDER BY b.item_id) AS n FROM o JOIN benchmark b ON contains(lower(b.text), o.term) QUALIFY n <= 3),
d AS (SELECT conv_id, turn, item_id, min((ord, term)) AS first FROM h GROUP BY ALL)
SELECT conv_id, turn, item_id, first[2] AS term, row_number() OVER (PARTITION BY conv_id, turn ORDER BY first[1], item_id) AS rank FROM d QUALIFY rank <= 10""")
def entity_seeding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages as named entities: those that hold a term of a user's turn, three a term, ten different ones a turn,
    in the order of the terms. Each different term is looked for once, whoever asked it."""
    c = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.posexplode(query_terms(F.col("text"))).alias("ord", "term"))
    names = broadcast_if_small(table(spark, sf_dir, "benchmark").select("item_id", F.lower("text").alias("name")), 10_000)
    held = c.select("term").distinct().join(names, F.col("name").contains(F.col("term")))
    first = top_n(held, ["term"], [F.asc("item_id")], 3, "n").select("term", "item_id")
    found = c.join(first, "term").groupBy("conv_id", "turn", "item_id").agg(F.min(F.struct("ord", "term")).alias("f"))
    return top_n(found.select("conv_id", "turn", "item_id", "f.term", "f.ord"), ["conv_id", "turn"], [F.asc("ord"), F.asc("item_id")], 10).drop("ord")
