"""Claims, verdicts, confidence, gates, routing and benchmark metrics as column rules and conditional counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.expressions import any_of
from quillstone.functions.tables import broadcast_if_small, written

# Words that send a question one way or the other, and what ends an answer as a refusal.
RELATIONAL = ["which drugs", "what drugs", "drugs treat", "what tests", "lab test for", "interactions", "side effects of", "causes of", "treats", "mapped to", "relationship between", "mechanism of action"]
OUT_OF_SCOPE = ["poem", "haiku", "sing", "code", "python", "weather", "recipe", "joke", "capital of", "who wrote", "sports", "football"]
MEDICAL = [
    "guideline", "treatment", "diagnosis", "symptom", "dosage", "inr", "hemoglobin", "troponin", "metformin", "aspirin", "dvt", "sepsis",
    "potassium", "hyperkalemia", "beta blocker", "ace inhibitor", "hypertension", "disease", "drug", "blood pressure", "anemia", "cardiac", "infarction",
]
# What marks a sentence about the evidence rather than of it.
ASIDES = [
    "this is information",
    "medical advice",
    "consult your physician",
    "consult a healthcare",
    "consult a physician",
    "the provided evidence does not",
    "the evidence provided does not",
    "does not specifically mention",
    "does not detail",
    "based on the given evidence",
    "i cannot provide",
    "i cannot confirm",
    "it cannot be concluded",
    "for specific treatment recommendations",
    "refer to current clinical practice",
    "refer to the full guideline",
    "the documents discuss",
]
HEDGES = ["does not", "cannot", "insufficient", "⚠️"]


def routed(text: Column, has_report: Column, whole_words: bool = False) -> Column:
    """report, out_of_scope, knowledge_graph or medical_query, in that order of the rules."""
    low = F.lower(F.coalesce(text, F.lit("")))

    def hit(words: list[str]) -> Column:
        return low.rlike(r"\b(?:" + "|".join(words) + r")\b") if whole_words else any_of(low, words)

    return F.when(has_report, "report").when(hit(OUT_OF_SCOPE), "out_of_scope").when(hit(RELATIONAL), "knowledge_graph").otherwise("medical_query")


def mechanism(text: Column, has_report: Column) -> Column:
    """rule_first where a rule decides the route (a word of medicine is one), else rule_default."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.when(has_report | any_of(low, [*OUT_OF_SCOPE, *RELATIONAL, *MEDICAL]), "rule_first").otherwise("rule_default")


def labelled_claims(answer: Column, cited: Column, most: int = 4) -> Column:
    """array<struct(claim, labels)>: an answer's first sentences without those that speak of the evidence or give advice, each
    with the labels [E…] in it or else all that are ``cited``. If no sentence is left, 300 characters of the first."""
    trimmed = F.regexp_replace(F.coalesce(answer, F.lit("")), r"^\s+|\s+$", "")
    every = F.filter(F.split(trimmed, r"(?<=[.!?])\s+"), lambda s: s != "")
    own = lambda s: F.regexp_extract_all(s, F.lit(r"\[E[0-9]+\]"), F.lit(0))
    made = lambda s: F.struct(s.alias("claim"), F.when(F.size(own(s)) > 0, own(s)).otherwise(cited).alias("labels"))
    kept = F.slice(F.filter(every, lambda s: ~any_of(F.lower(s), ASIDES)), 1, most)
    first = F.transform(F.slice(every, 1, 1), lambda s: F.struct(F.substring(s, 1, 300).alias("claim"), cited.alias("labels")))
    return F.when(F.size(kept) > 0, F.transform(kept, made)).otherwise(first)


def verdict(text: Column) -> Column:
    """supported, contradicted, refusal_valid or not_mentioned; negated forms are read first."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.when(low.rlike("unsupported|not[_ ]supported|not[_ ]mentioned"), "not_mentioned").when(low.contains("contradict"), "contradicted").when(low.contains("refusal"), "refusal_valid").when(low.contains("supported"), "supported").otherwise("not_mentioned")


def faithfulness(df: DataFrame, answer: str, verdict_col: str) -> DataFrame:
    """(answer, n, faithfulness): supported and valid refusals over all; 1 without claims or if all are refusals, 0 if all are contradicted."""
    n, v = F.count(verdict_col), F.col(verdict_col)
    good = F.count_if(v.isin("supported", "refusal_valid"))
    score = F.when(n == 0, 1.0).when(F.count_if(v == "contradicted") == n, 0.0).otherwise(good / F.nullif(n, F.lit(0)))
    return df.groupBy(answer).agg(n.alias("n"), F.round(score, 4).alias("faithfulness"), F.max(F.coalesce(v == "contradicted", F.lit(False))).alias("contradicted"))


def final_confidence(evidence: Column, faithful: Column) -> Column:
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.4 * evidence + 0.6 * faithful)), 3)


def tier(confidence: Column) -> Column:
    return F.when(confidence >= 0.75, "high").when(confidence >= 0.5, "medium").otherwise("low")


def answer_status(refused: Column, contradicted: Column, confidence: Column) -> Column:
    return F.when(refused, "refusal").when(contradicted, "contradiction_detected").when(confidence >= 0.75, "verified").when(confidence >= 0.5, "caution").otherwise("uncertain")


def needs_retry(refused: Column, contradicted: Column, confidence: Column, least: float = 0.5) -> Column:
    """Whether an answer is tried again: not a refusal, and of low confidence or contradicted by its evidence."""
    return ~refused & ((confidence < least) | contradicted)


def choice(answer: Column) -> Column:
    """The first A-D in 60 characters; none for a refusal that has no A-D in its first 30."""
    a = F.coalesce(answer, F.lit(""))
    refused = any_of(F.lower(a), ["consult", "cannot answer", "insufficient evidence"]) & ~F.substring(a, 1, 30).rlike(r"\b[A-D]\b")
    return F.when(~refused, F.nullif(F.regexp_extract(F.substring(a, 1, 60), r"\b([A-D])\b", 1), F.lit("")))


def qa_metrics(df: DataFrame, by: list[str], gold: str, given: str, answer: str | None = None) -> DataFrame:
    """Accuracy of all and of answered, rates of answers, refusals and wrong assertions, in percent of each group; with the
    answers' text, also the rate of answers that hedge."""
    n, done, right = F.count(F.lit(1)), F.count(given), F.count_if(F.col(given) == F.col(gold))
    pct = lambda a, b: F.round(F.try_divide(100.0 * a, b), 2)
    out = [n.alias("n"), pct(right, n).alias("accuracy"), pct(right, done).alias("accuracy_answered"), pct(done, n).alias("answered"), pct(n - done, n).alias("refused"), pct(done - right, n).alias("wrong")]
    if answer:
        out.append(pct(F.count_if(F.col(given).isNotNull() & any_of(F.lower(F.col(answer)), HEDGES)), n).alias("hedged"))
    return df.groupBy(*by).agg(*out)


def upper_median(df: DataFrame, by: list[str], value: str, most: int = 10_000, splitters: int = 32) -> DataFrame:
    """sorted[n // 2] of each group, exactly. In each round splitters of equal depth (mergeable sketches of what is left) cut a group's
    range, exact counts say which part holds the median, and only that part goes on; a value that is a splitter is a part of
    its own. So a part has about 1 / ``splitters`` of its rows however they lie, and no more than ``most`` rows of different
    values of a group are put in order."""
    rows = written(df.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v")), "values")
    state = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    state = written(state.withColumns({"_at": F.floor(F.col("n") / 2), "_before": F.lit(0).cast("long"), "_in": F.col("n")}), "medians")
    wide = (F.col("_in") > most) & (F.col("_lo") < F.col("_hi"))
    while not (large := state.where(wide)).isEmpty():
        live = rows.join(broadcast_if_small(large), by).where(F.col("_v").between(F.col("_lo"), F.col("_hi")))
        cuts = live.groupBy(*by).agg(F.percentile_approx("_v", [(i + 1) / splitters for i in range(splitters - 1)], 1000).alias("_cuts"))
        placed = live.join(broadcast_if_small(written(cuts, "cuts")), by)
        part = 2 * F.size(F.filter("_cuts", lambda c: c < F.col("_v"))) + F.array_contains("_cuts", F.col("_v")).cast("int")
        counts = placed.groupBy(*by, part.alias("_part")).agg(
            F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_l"), F.max("_v").alias("_h"), *[F.first(c).alias(c) for c in ("n", "_at", "_before")]
        )
        upto = F.col("_before") + F.sum("_c").over(Window.partitionBy(*by).orderBy("_part"))  # at most 2 * splitters rows a group
        held = counts.withColumn("_upto", upto).where((F.col("_upto") > F.col("_at")) & (F.col("_upto") - F.col("_c") <= F.col("_at")))
        held = held.select(*by, "n", F.col("_l").alias("_lo"), F.col("_h").alias("_hi"), "_at", (F.col("_upto") - F.col("_c")).alias("_before"), F.col("_c").alias("_in"))
        state = written(state.where(~wide).unionByName(held), "medians")
    alone = state.where("_lo = _hi").select(*by, F.col("_lo").alias("median"), "n")
    inside = rows.join(broadcast_if_small(state.where("_lo < _hi")), by).where(F.col("_v").between(F.col("_lo"), F.col("_hi")))
    values = inside.groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_c"), *[F.first(c).alias(c) for c in ("n", "_at", "_before")])
    values = values.withColumn("_upto", F.col("_before") + F.sum("_c").over(Window.partitionBy(*by).orderBy("_v")))
    found = values.where((F.col("_upto") > F.col("_at")) & (F.col("_upto") - F.col("_c") <= F.col("_at"))).select(*by, F.col("_v").alias("median"), "n")
    return alone.unionByName(found)
