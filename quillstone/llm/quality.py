"""Quality rules with thresholds from mergeable quantile sketches per language and source; DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstone.functions.expressions import let
from quillstone.llm.shared import WHITE, WORD, Stage


@dataclass(frozen=True)
class Rule:
    """A share or mean that must not lie above its group's quantile ``tail`` by more than ``reach`` times that quantile's
    distance from the quantile ``base`` (``least`` at least; percents); with ``low``, nor likewise below that of 100 - tail."""

    name: str
    tail: int
    base: int
    reach: float
    least: float
    low: bool = False


RULES = (Rule("mean_word_chars", 75, 25, 4.0, 0.05, True), Rule("symbol_share", 90, 50, 3.0, 0.01), Rule("dup_line_share", 99, 50, 2.0, 0.02), Rule("repeat_share", 99, 50, 2.0, 0.02))
#: Rows below which a group takes the thresholds of its language, or of all.
LEAST_ROWS = 100
#: A sketch's cells: values below the first number are cut to a multiple of the second, which is a power of 2, and so on.
CELLS = ((2.0**4, 2.0**-10), (2.0**8, 2.0**-6), (2.0**12, 2.0**-2), (2.0**16, 2.0**2), (2.0**20, 2.0**6), (float("inf"), 2.0**10))
MIN_WORDS, MOST_REPEATED = 50, 50


def _repeat_words(words: Column) -> Column:
    """Words in 3-word windows that occur at least twice in the text."""
    n = F.size(words)
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))).otherwise(F.array().cast("array<bigint>"))

    def covered(pairs: Column) -> Column:
        again = F.filter(pairs, lambda x, i: F.coalesce(x["h"] == F.get(pairs, i - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(pairs, i + 1)["h"], F.lit(False)))
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).cast("long").alias("last"))
        at = F.sort_array(F.transform(again, lambda x: x["i"].cast("long")))
        return F.aggregate(at, start, lambda s, p: F.struct((s["n"] + F.least(F.lit(3).cast("long"), p - s["last"])).alias("n"), p.alias("last")), lambda s: s["n"])

    def found(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) < F.size(h), let(pairs, covered)).otherwise(F.lit(0).cast("long"))

    return let(windows, found)


def text_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Counts of each whole text (null: none) and base_failed."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words = F.array_remove(F.split(text, f"{WHITE}+"), "")
    counted = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).alias("n_repeat_words")))
    lines = let(F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)), lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    rows = docs.select(
        F.col(id_col).alias("rid"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"),
        counted.alias("w"), (F.length(text) - F.regexp_count(text, F.lit(WHITE))).cast("long").alias("word_chars"), F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"), lines.alias("l"),
    )
    rows = rows.select("rid", "lang", "source", "w.n_words", "word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words", "l.n_lines")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    words_ = F.greatest("n_words", F.lit(1))
    return rows.withColumns({
        "base_failed": failed, "mean_word_chars": F.col("word_chars") / words_, "symbol_share": F.col("n_symbols") / words_,
        "dup_line_share": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)), "repeat_share": F.col("n_repeat_words") / words_,
    })


def cell(value: Column) -> Column:
    """The cell of a sketch that holds a value: the value cut to about three digits (exact in binary)."""
    out = F.floor(value / CELLS[-1][1]) * CELLS[-1][1]
    for end, step in reversed(CELLS[:-1]):
        out = F.when(value < end, F.floor(value / step) * step).otherwise(out)
    return out


def sketches(rows: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(lang, source, rule, cell, n): a quantile sketch of each rule's values per language and source, over the rows that
    pass the base rules. Sketches are merged by adding; no order of rows or merges changes one."""
    values = F.explode(F.array(*[F.struct(F.lit(i).alias("rule"), cell(F.col(r.name)).alias("cell")) for i, r in enumerate(rules)])).alias("_v")
    return rows.where("not base_failed").select("lang", "source", values).groupBy("lang", "source", "_v.rule", "_v.cell").agg(F.count(F.lit(1)).alias("n"))


def _quantiles(cells: DataFrame, keys: list[str], percents: list[int]) -> DataFrame:
    """(keys, rule, n, p25 ...): of each sketch the cells of the ranks ceil(n * percent / 100)."""
    by = Window.partitionBy(*keys, "rule")
    below = cells.withColumns({"_to": F.sum("n").over(by.orderBy("cell")), "_all": F.sum("n").over(by)})
    found = [F.min(F.when(F.col("_to") * 100 >= F.col("_all") * p, F.col("cell"))).alias(f"p{p}") for p in percents]
    return below.groupBy(*keys, "rule").agg(F.first("_all").alias("n"), *found)


def thresholds(rows: DataFrame, stage: Stage, rules: tuple[Rule, ...] = RULES, least_rows: int = LEAST_ROWS) -> DataFrame:
    """(lang, source, low and high of each rule) from the rows that pass the base rules.

    One sketch per rule, language and source (counted in part before the shuffle); those of a language's sources merge
    into the language's, and those into one of all, so the fallbacks of small groups need no second pass over the rows.
    """
    percents = sorted({p for r in rules for p in (r.tail, r.base, 100 - r.tail)})
    own = stage.cut(sketches(rows, rules), "sketches")
    by_lang = own.groupBy("lang", "rule", "cell").agg(F.sum("n").alias("n"))
    of_all = by_lang.groupBy("rule", "cell").agg(F.sum("n").alias("n"))
    o, g, a = (_quantiles(cells, keys, percents).alias(name) for cells, keys, name in ((own, ["lang", "source"], "o"), (by_lang, ["lang"], "g"), (of_all, [], "a")))
    joined = o.join(g, F.col("o.lang").eqNullSafe(F.col("g.lang")) & (F.col("o.rule") == F.col("g.rule"))).join(F.broadcast(a), F.col("o.rule") == F.col("a.rule"))  # a row per rule
    at = {p: F.when(F.col("o.n") >= least_rows, F.col(f"o.p{p}")).when(F.col("g.n") >= least_rows, F.col(f"g.p{p}")).otherwise(F.col(f"a.p{p}")) for p in percents}
    ends = []
    for i, r in enumerate(rules):
        wide = r.reach * F.greatest(at[r.tail] - at[r.base], F.lit(r.least))
        for name, end in (("low", at[100 - r.tail] - wide), ("high", at[r.tail] + wide)):
            ends.append(F.max(F.when(F.col("o.rule") == i, end)).alias(f"{r.name}_{name}"))
    return joined.groupBy(F.col("o.lang").alias("lang"), F.col("o.source").alias("source")).agg(*ends)


def quality_rules(spark: SparkSession, docs: DataFrame, rules: tuple[Rule, ...] = RULES, least_rows: int = LEAST_ROWS, id_col: str = "doc_id", **columns: str) -> DataFrame:
    """One row per row of ``docs``: its id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    A text is kept if it passes the base rules (50 words, at most half of them in repeated 3-word windows) and each rule's
    value lies within its language's and source's thresholds, which are quantiles moved outwards by the group's own spread.

    Texts of any length are read whole. Null and blank texts have no words and fail. A null language or source is a value of its own. A group whose rows all
    fail gets no thresholds and needs none. Null ids and repeated rows are kept as they are. An empty table gives no
    rows. Other columns are ignored.
    """
    stage = Stage(spark, "quality")
    rows = stage.cut(text_features(docs, id_col, **columns), "features")
    limits = stage.cut(thresholds(rows, stage, rules, least_rows), "thresholds")
    r, t = rows.alias("r"), limits.alias("t")
    both = r.join(t, F.col("r.lang").eqNullSafe(F.col("t.lang")) & F.col("r.source").eqNullSafe(F.col("t.source")), "left")
    fine = ~F.col("base_failed")
    for rule in rules:
        if rule.low:
            fine = fine & (F.col(rule.name) >= F.col(f"{rule.name}_low"))
        fine = fine & (F.col(rule.name) <= F.col(f"{rule.name}_high"))
    return both.select(F.col("rid").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.coalesce(fine, F.lit(False)).alias("kept"))
