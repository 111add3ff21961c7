"""A graph out of vocabulary rows: concepts by their types, terms, relations, links between registries, tests and causes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Types of concepts that count as diseases, vocabularies with their priorities, kinds of relations, and which
# diseases a category of tests speaks of.
DISEASE_TYPES = ["Disease or Syndrome", "Finding", "Sign or Symptom", "Neoplastic Process", "Pathologic Function"]
TERM_PRIORITY = {"SNOMEDCT_US": 10, "NCI": 8, "MSH": 7, "ICD10CM": 6, "ICD10": 5}
DEFINITION_PRIORITY = {"MSH": 5, "NCI": 4, "SNOMEDCT_US": 3, "CSP": 2}
RELATION_VOCABULARIES = ["SNOMEDCT_US", "MSH", "NCI", "ICD10CM", "MTHICD9", "LNC", "CPT", "RXNORM"]
IS_A, RELATED = ["PAR", "CHD", "RB", "RN"], ["RO", "SY"]
DISEASES_OF_TESTS = {
    "CBC": ["Anemia", "Leukemia", "Thrombocytopenia"],
    "KFT": ["Chronic Kidney Disease", "Acute Kidney Injury"],
    "LFT": ["Liver Disease", "Hepatitis", "Cirrhosis"],
    "Chemistry": ["Diabetes Mellitus", "Hypoglycemia"],
    "Electrolytes": ["Hypokalemia", "Hyperkalemia", "Hyponatremia"],
    "Coagulation": ["Coagulopathy", "Hemophilia", "Thrombosis"],
    "Thyroid": ["Hypothyroidism", "Hyperthyroidism"],
    "Cardiac": ["Heart Failure", "Myocardial Infarction"],
    "Microbiology": ["Sepsis", "Bacteremia", "Infection"],
    "Lipids": ["Hyperlipidemia", "Atherosclerosis"],
    "Urinalysis": ["Urinary Tract Infection", "Nephritis"],
}
CAUSES = [
    ("creatinine", ["Chronic Kidney Disease", "Acute Kidney Injury"]),
    ("hemoglobin a1c", ["Type 2 Diabetes Mellitus", "Impaired Glucose Tolerance"]),
    ("hba1c", ["Type 2 Diabetes Mellitus", "Impaired Glucose Tolerance"]),
    ("potassium", ["Hyperkalemia", "Hypokalemia"]),
    ("sodium", ["Hyponatremia", "Hypernatremia"]),
]


def at(cells: Column, i: int) -> Column:
    return F.get(cells, F.lit(i))


def not_suppressed(cells: Column, i: int) -> Column:
    """Whether a row isn't marked Y in column ``i``; rows that end before it aren't."""
    return F.coalesce(at(cells, i), F.lit("N")) != "Y"


def concepts_of_types(rows: DataFrame, types: list[str] = DISEASE_TYPES) -> DataFrame:
    """(id): concepts that a type row (0 id, 3 type) gives one of the types."""
    return rows.where((F.size("cells") >= 4) & at(F.col("cells"), 3).isin(types)).select(at(F.col("cells"), 0).alias("id")).distinct()


def made_once(rows: DataFrame) -> DataFrame:
    """Rows whose cells are computed once: filters and columns above would each compute them again, as Spark moves filters below what
    makes their columns, but not below an explode."""
    return rows.select(F.explode(F.array("cells")).alias("cells"))


def term_rows(rows: DataFrame, concepts: DataFrame) -> DataFrame:
    """(id, vocabulary, code, term, preferred, priority) of English terms of the concepts that aren't suppressed, from known vocabularies."""
    c = F.col("cells")
    fine = made_once(rows).where((F.size(c) >= 15) & (at(c, 1) == "ENG") & not_suppressed(c, 16) & at(c, 11).isin(list(TERM_PRIORITY)))
    known = F.create_map(*[F.lit(x) for kv in TERM_PRIORITY.items() for x in kv])
    out = fine.select(at(c, 0).alias("id"), at(c, 11).alias("vocabulary"), at(c, 13).alias("code"), at(c, 14).alias("term"), (at(c, 6) == "Y").alias("preferred"), known[at(c, 11)].alias("priority"))
    return out.join(concepts, "id", "left_semi")


def definition_rows(rows: DataFrame, concepts: DataFrame) -> DataFrame:
    """(id, definition, priority): definitions of the concepts that aren't suppressed, any vocabulary, known ones first."""
    c = F.col("cells")
    known = F.create_map(*[F.lit(x) for kv in DEFINITION_PRIORITY.items() for x in kv])
    out = rows.where((F.size(c) >= 6) & not_suppressed(c, 6)).select(at(c, 0).alias("id"), at(c, 5).alias("definition"), F.coalesce(F.try_element_at(known, at(c, 4)), F.lit(1)).alias("priority"))
    return out.join(concepts, "id", "left_semi")


def relation_edges(rows: DataFrame, concepts: DataFrame) -> DataFrame:
    """(src, dst, edge, relation, label, vocabulary): IS_A and RELATED_TO edges between the concepts; other relations go."""
    c = F.col("cells")
    edge = F.when(at(c, 3).isin(IS_A), "IS_A").when(at(c, 3).isin(RELATED), "RELATED_TO")
    fine = rows.where((F.size(c) >= 11) & not_suppressed(c, 14) & at(c, 10).isin(RELATION_VOCABULARIES) & edge.isNotNull())
    label = F.when(edge == "RELATED_TO", F.substring(F.coalesce(at(c, 7), F.lit("")), 1, 50))
    out = fine.select(at(c, 0).alias("src"), at(c, 4).alias("dst"), edge.alias("edge"), at(c, 3).alias("relation"), label.alias("label"), at(c, 10).alias("vocabulary"))
    ids = lambda name: concepts.select(F.col("id").alias(name))
    return out.join(ids("src"), "src", "left_semi").join(ids("dst"), "dst", "left_semi")


def registry_edges(rows: DataFrame, nodes: DataFrame, least: int, drug: int, concept: int, **more: int) -> DataFrame:
    """(src, dst, and columns by position) of rows with ``least`` cells whose drug is a resolved node and whose concept id begins with C."""
    c = F.col("cells")
    fine = rows.where((F.size(c) >= least) & at(c, concept).startswith("C"))
    out = fine.select(at(c, drug).alias("src"), at(c, concept).alias("dst"), *[at(c, i).alias(k) for k, i in more.items()])
    return out.join(nodes.where(F.col("id").startswith("CID")).select(F.col("id").alias("src")).distinct(), "src", "left_semi")


def tests_to_diseases(spark: SparkSession, tests: DataFrame, diseases: DataFrame, known: dict[str, list[str]] = DISEASES_OF_TESTS) -> DataFrame:
    """(test, disease) edges: a test's category names diseases, whose exact names have ids."""
    pairs = F.broadcast(spark.createDataFrame([(c, d) for c, ds in known.items() for d in ds], "category string, name string"))
    return tests.join(pairs, "category").join(diseases, "name").select("test", F.col("id").alias("disease"))


def causes(tests: DataFrame, edges: DataFrame, fallback: list[tuple[str, list[str]]] = CAUSES) -> DataFrame:
    """(test_name, disease, known): diseases that the graph relates to a test's exact name (without its brackets, in lower case), without one
    electrolyte's diseases for another; a test without any gets those of the first fallback name inside its own."""
    clean = F.lower(F.trim(F.regexp_replace("test_name", r"\(.*?\)", "")))
    named = tests.select("test_name").distinct().withColumn("_clean", clean)
    mixed = ((F.col("_clean") == "potassium") & F.lower("disease").contains("natremia")) | ((F.col("_clean") == "sodium") & F.lower("disease").contains("kalemia"))
    graph = edges.select(F.lower("test").alias("_clean"), F.trim("disease").alias("disease")).distinct()
    found = named.join(graph, "_clean").where(~mixed).select("test_name", "disease", F.lit(True).alias("known"))
    other = F.lit(None).cast("array<string>")
    for name, diseases in reversed(fallback):
        other = F.when(F.col("_clean").contains(name), F.array(*map(F.lit, diseases))).otherwise(other)
    rest = named.join(found.select("test_name").distinct(), "test_name", "left_anti").select("test_name", F.explode(other).alias("disease"), F.lit(False).alias("known"))
    return found.unionByName(rest)
