"""Vocabulary queries: the test tables as positional rows of concepts, terms, relations and registries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators.concepts import CAUSES, DISEASES_OF_TESTS, causes, concepts_of_types, definition_rows, registry_edges, relation_edges, term_rows, tests_to_diseases
from quillstone.operators.dedup import alias_fold, best_by_priority
from quillstone.plans.catalog import query, table
from quillstone.plans.clinical import measurements

# Types go by a part's size; every ninth row is too short to have one.
_TYPE = "CASE p_size % 7 WHEN 0 THEN 'Disease or Syndrome' WHEN 1 THEN 'Finding' WHEN 2 THEN 'finding' WHEN 3 THEN 'Neoplastic Process' WHEN 4 THEN 'Geographic Area' ELSE 'Enzyme' END"
_TYPED = "SELECT DISTINCT 'C' || p_partkey AS id FROM part WHERE p_size % 7 IN (0, 1, 3) AND p_partkey % 9 <> 0"


def _concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = F.array(F.concat(F.lit("C"), F.col("p_partkey").cast("string")), F.lit(""), F.lit(""), F.expr(_TYPE))
    rows = table(spark, sf_dir, "part").select(F.when(F.col("p_partkey") % 9 == 0, F.slice(cells, 1, 3)).otherwise(cells).alias("cells"))
    return concepts_of_types(rows)


@query(_TYPED)
def concept_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of concepts of five types, exactly named; rows without a type are left out."""
    return _concepts(spark, sf_dir)


_VOCABULARY = "CASE l_suppkey % 7 WHEN 0 THEN 'SNOMEDCT_US' WHEN 1 THEN 'NCI' WHEN 2 THEN 'MSH' WHEN 3 THEN 'ICD10CM' WHEN 4 THEN 'ICD10' WHEN 5 THEN 'CPT' ELSE 'XX' END"
_TERM_SQL = f"""t AS (SELECT 'C' || l_partkey AS id, {_VOCABULARY} AS vocabulary, l_returnflag || l_suppkey AS code, 'term ' || l_suppkey AS term, l_linenumber = 1 AS preferred,
  CASE {_VOCABULARY} WHEN 'SNOMEDCT_US' THEN 10 WHEN 'NCI' THEN 8 WHEN 'MSH' THEN 7 WHEN 'ICD10CM' THEN 6 WHEN 'ICD10' THEN 5 END AS priority, (l_orderkey * 10 + l_linenumber) * 1000000 + l_suppkey AS ord
  FROM lineitem WHERE l_returnflag <> 'N' AND NOT (l_linestatus = 'F' AND l_orderkey % 4 = 0) AND {_VOCABULARY} NOT IN ('CPT', 'XX') AND l_orderkey % 11 <> 0 AND 'C' || l_partkey IN ({_TYPED}))"""


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as term rows: returned ones are English, some are suppressed, some end before that mark, some are too short."""
    li = table(spark, sf_dir, "lineitem")
    language, mark = F.when(F.col("l_returnflag") == "N", "GER").otherwise("ENG"), F.when((F.col("l_linestatus") == "F") & (F.col("l_orderkey") % 4 == 0), "Y").otherwise("N")
    text = lambda c: F.col(c).cast("string")
    filler = F.lit("")
    cells = F.array(
        F.concat(F.lit("C"), text("l_partkey")), language, *[filler] * 4, F.when(F.col("l_linenumber") == 1, "Y").otherwise("N"), *[filler] * 4, F.expr(_VOCABULARY), filler,
        F.concat("l_returnflag", text("l_suppkey")), F.concat(F.lit("term "), text("l_suppkey")), filler, mark,
    )
    ends = F.when(F.col("l_orderkey") % 11 == 0, F.slice(cells, 1, 14)).when(mark == "N", F.slice(cells, 1, 16)).otherwise(cells)
    return term_rows(li.select(ends.alias("cells")), _concepts(spark, sf_dir))


@query(f"WITH {_TERM_SQL} SELECT id, vocabulary, code, term, preferred, priority, count(*) AS n FROM t GROUP BY ALL")
def concept_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English terms of the concepts from five vocabularies, as the bag they are."""
    t = _terms(spark, sf_dir)
    return t.groupBy(*t.columns).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_TERM_SQL}, o AS (SELECT id, term, priority, min(vocabulary || code) AS o FROM t GROUP BY ALL), b AS (SELECT id, arg_min(term, (-priority, o)) AS term FROM o GROUP BY id)
SELECT b.id, b.term, count(DISTINCT o.term) AS terms FROM b JOIN o ON o.id = b.id GROUP BY b.id, b.term""")
def concept_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The name of each concept: its term from the vocabulary of the highest priority, the first code of equals."""
    best = F.min(F.struct((-F.col("priority")).alias("p"), F.concat("vocabulary", "code").alias("o"))).alias("best")
    return _terms(spark, sf_dir).groupBy("id", "term").agg(best).groupBy("id").agg(F.min_by("term", "best").alias("term"), F.count("term").alias("terms"))


@query(f"""SELECT id, arg_min(definition, (-priority, definition)) AS definition FROM (SELECT 'C' || l_partkey AS id, 'about ' || l_shipdate::DATE AS definition,
CASE l_suppkey % 6 WHEN 0 THEN 5 WHEN 1 THEN 4 WHEN 2 THEN 3 WHEN 3 THEN 2 ELSE 1 END AS priority FROM lineitem WHERE l_returnflag <> 'N') WHERE id IN ({_TYPED}) GROUP BY id""")
def concept_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One definition a concept, by the vocabularies' order of preference; suppressed ones (N here) are left out."""
    li = table(spark, sf_dir, "lineitem")
    vocabulary = F.element_at(F.array(*map(F.lit, ["MSH", "NCI", "SNOMEDCT_US", "CSP", "XX", "YY"])), (F.col("l_suppkey") % 6 + 1).cast("int"))
    said = F.concat(F.lit("about "), F.col("l_shipdate").cast("date").cast("string"))
    cells = F.array(F.concat(F.lit("C"), F.col("l_partkey").cast("string")), F.lit(""), F.lit(""), F.lit(""), vocabulary, said, F.when(F.col("l_returnflag") == "N", "Y").otherwise("N"))
    return best_by_priority(definition_rows(li.select(cells.alias("cells")), _concepts(spark, sf_dir)), "id", "priority", "definition").select("id", "definition")


_RELATION = "CASE l_linenumber % 7 WHEN 1 THEN 'PAR' WHEN 2 THEN 'CHD' WHEN 3 THEN 'RB' WHEN 4 THEN 'RN' WHEN 5 THEN 'RO' WHEN 6 THEN 'SY' ELSE 'AQ' END"
_SOURCE = "CASE l_suppkey % 5 WHEN 0 THEN 'SNOMEDCT_US' WHEN 1 THEN 'LNC' WHEN 2 THEN 'RXNORM' WHEN 3 THEN 'XX' ELSE 'CPT' END"


@query(f"""SELECT src, dst, CASE WHEN relation IN ('PAR', 'CHD', 'RB', 'RN') THEN 'IS_A' ELSE 'RELATED_TO' END AS edge, relation, CASE WHEN relation IN ('RO', 'SY') THEN label END AS label, vocabulary, count(*) AS n
FROM (SELECT 'C' || l_partkey AS src, 'C' || (l_partkey * 7 + l_suppkey) % 300 AS dst, {_RELATION} AS relation, 'by ' || l_returnflag AS label, {_SOURCE} AS vocabulary FROM lineitem WHERE l_linestatus = 'O')
WHERE relation <> 'AQ' AND vocabulary <> 'XX' AND src IN ({_TYPED}) AND dst IN ({_TYPED}) GROUP BY ALL""")
def concept_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between concepts, by kind of relation; suppressed rows, other relations and vocabularies go."""
    li = table(spark, sf_dir, "lineitem")
    other = F.concat(F.lit("C"), ((F.col("l_partkey") * 7 + F.col("l_suppkey")) % 300).cast("string"))
    x = F.lit("")
    cells = F.array(F.concat(F.lit("C"), F.col("l_partkey").cast("string")), x, x, F.expr(_RELATION), other, x, x, F.concat(F.lit("by "), "l_returnflag"), x, x, F.expr(_SOURCE), x, x, x, F.when(F.col("l_linestatus") == "O", "N").otherwise("Y"))
    e = relation_edges(li.select(cells.alias("cells")), _concepts(spark, sf_dir))
    return e.groupBy(*e.columns).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT 'CID' || o_custkey AS src, 'C' || o_orderkey AS dst, o_orderpriority AS frequency, o_orderstatus AS kind FROM orders
WHERE o_orderkey % 6 <> 0 AND o_orderkey % 5 <> 0 AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 4 <> 1)""")
def registry_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as rows of drugs and concepts: the drug must be the resolved id of some node, the concept's id begin with C, the row be whole."""
    c = table(spark, sf_dir, "customer")
    nodes = c.select(F.concat(F.when(F.col("c_custkey") % 4 == 1, "DB").otherwise("CID"), F.col("c_custkey").cast("string")).alias("id"))
    concept = F.concat(F.when(F.col("o_orderkey") % 5 == 0, "X").otherwise("C"), F.col("o_orderkey").cast("string"))
    x = F.lit("")
    cells = F.array(F.concat(F.lit("CID"), F.col("o_custkey").cast("string")), x, concept, x, x, "o_orderpriority", x, "o_orderstatus", x, F.lit("term"))
    rows = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 6 == 0, F.slice(cells, 1, 9)).otherwise(cells).alias("cells"))
    return registry_edges(rows, nodes, 10, 0, 2, frequency=5, kind=7)


_CATS = list(DISEASES_OF_TESTS)
_NAMES = sorted({d for ds in DISEASES_OF_TESTS.values() for d in ds})
_OF = ", ".join(f"('{c}', '{d}')" for c, ds in DISEASES_OF_TESTS.items() for d in ds)


@query(f"""WITH d AS (SELECT 'D' || n_nationkey AS id, ([{", ".join(repr(x) for x in _NAMES)}])[n_nationkey + 1] AS name FROM nation), t AS (SELECT 'T' || p_partkey AS test, ([{", ".join(repr(x) for x in [*_CATS, "Other"])}])[p_size % {len(_CATS) + 1} + 1] AS category FROM part)
SELECT test, d.id AS disease FROM t JOIN (VALUES {_OF}) o(category, name) ON o.category = t.category JOIN d ON d.name = o.name""")
def category_diseases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as tests of a category, nations as diseases: a category's disease names give edges to their ids."""
    pick = lambda names, i: F.get(F.array(*map(F.lit, names)), i)
    d = table(spark, sf_dir, "nation").select(F.concat(F.lit("D"), F.col("n_nationkey").cast("string")).alias("id"), pick(_NAMES, F.col("n_nationkey")).alias("name")).where("name is not null")
    t = table(spark, sf_dir, "part").select(F.concat(F.lit("T"), F.col("p_partkey").cast("string")).alias("test"), pick([*_CATS, "Other"], F.col("p_size") % (len(_CATS) + 1)).alias("category"))
    return tests_to_diseases(spark, t, d)


_FALL = "CASE " + " ".join(f"WHEN contains(c, '{k}') THEN {v!r}" for k, v in CAUSES) + " ELSE [] END"


@query(f"""WITH t AS (SELECT DISTINCT CASE event_type WHEN 'click' THEN 'Creatinine (serum)' WHEN 'view' THEN 'HbA1c' WHEN 'purchase' THEN 'Potassium' WHEN 'signup' THEN 'Fasting Glucose' ELSE 'Ferritin' END || CASE WHEN user_id % 2 = 0 THEN '' ELSE ' (plasma)' END AS test_name FROM events),
c AS (SELECT test_name, lower(trim(regexp_replace(test_name, '\\(.*?\\)', '', 'g'))) AS c FROM t),
g AS (SELECT DISTINCT CASE n_nationkey % 3 WHEN 0 THEN 'potassium' WHEN 1 THEN 'fasting glucose' ELSE 'sodium' END AS c, CASE n_nationkey % 4 WHEN 0 THEN 'Hyponatremia' ELSE n_name END AS disease FROM nation),
k AS (SELECT test_name, disease FROM c JOIN g USING (c) WHERE NOT (c = 'potassium' AND contains(lower(disease), 'natremia')) AND NOT (c = 'sodium' AND contains(lower(disease), 'kalemia')))
SELECT test_name, disease, true AS known FROM k UNION ALL SELECT test_name, unnest({_FALL}) AS disease, false FROM c WHERE test_name NOT IN (SELECT test_name FROM k)""")
def test_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diseases that may explain a test: from the graph (nations here) by exact name, else from a short list."""
    m = measurements(spark, sf_dir)
    tests = m.select(F.concat("test_name", F.when(F.col("user_id") % 2 == 0, "").otherwise(" (plasma)")).alias("test_name"))
    k = F.col("n_nationkey")
    edges = table(spark, sf_dir, "nation").select(F.when(k % 3 == 0, "Potassium").when(k % 3 == 1, "Fasting glucose").otherwise("Sodium").alias("test"), F.when(k % 4 == 0, "Hyponatremia").otherwise(F.col("n_name")).alias("disease"))
    return causes(tests, edges)


@query(f"""WITH {_TERM_SQL}, r AS (SELECT id, term, priority, ord, max(row(priority, -ord, term)) OVER (PARTITION BY id ORDER BY ord) AS now FROM t),
a AS (SELECT id, term, min(ord) AS o FROM r WHERE term <> now[3] GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY o) AS k FROM a QUALIFY k <= 20)
SELECT b.id, b.term, coalesce(x.aliases, '') AS aliases FROM (SELECT id, arg_max(term, (priority, -ord)) AS term FROM t GROUP BY id) b LEFT JOIN (SELECT id, string_agg(term, ',' ORDER BY o) AS aliases FROM n GROUP BY id) x USING (id)""")
def concept_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A concept's term and its other terms in order of arrival, twenty at most."""
    li = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'N' and not (l_linestatus = 'F' and l_orderkey % 4 = 0) and l_orderkey % 11 <> 0")
    known = F.element_at(F.array(*map(F.lit, [10, 8, 7, 6, 5])), (F.col("l_suppkey") % 7 + 1).cast("int"))
    rows = li.where("l_suppkey % 7 < 5").select(
        F.concat(F.lit("C"), F.col("l_partkey").cast("string")).alias("id"), F.concat(F.lit("term "), F.col("l_suppkey").cast("string")).alias("term"), known.alias("priority"), ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1_000_000 + F.col("l_suppkey")).alias("ord")
    )
    return alias_fold(rows.join(_concepts(spark, sf_dir), "id", "left_semi"), "id", "term", "priority", "ord").withColumn("aliases", F.array_join("aliases", ","))
