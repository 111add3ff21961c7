"""Names mapped by the longest alias in them: one pass of an automaton over each different name, and what follows where there is none."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions.tables import broadcast_if_small, written
from quillstone.operators.containment import contains_join

#: Aliases that an automaton is made of at most (counted), which goes to every task; more of them are joined by their grams.
MOST_SENT = 200_000
#: Characters of a name that a test's name must hold where no alias fits.
PREFIX = 15
# Factors of units, by a test's name and its units, in this order.
UNIT_FACTORS = [
    ("creatinine_mg/dl->umol/l", 88.4), ("creatinine_mg/dl->µmol/l", 88.4), ("glucose_mg/dl->mmol/l", 0.0555), ("hemoglobin_g/dl->g/l", 10.0), ("hemoglobin_g/dl->g/dl", 1.0),
    ("potassium_mmol/l->mmol/l", 1.0), ("potassium_meq/l->mmol/l", 1.0), ("sodium_mmol/l->mmol/l", 1.0), ("sodium_meq/l->mmol/l", 1.0), ("platelet_10^9/l->10^9/l", 1.0), ("wbc_10^9/l->10^9/l", 1.0),
]


def clean(name: Column) -> Column:
    """Lower case, without what is in brackets."""
    return F.trim(F.regexp_replace(F.lower(F.trim(F.coalesce(name, F.lit("")))), r"\(.*?\)", ""))


def longest_alias(names: DataFrame, aliases: DataFrame, most_sent: int = MOST_SENT) -> DataFrame:
    """(name, alias, exact): of each different name the alias that is the whole name, else the longest in it, the first of
    equals by ``ord``; names without any have no row. ``aliases`` is (alias, ord); empty and null ones are none.

    Names that are an alias are found by an equi-join. The others go through an automaton of all aliases, which reads each
    name once and gives one row; beyond ``most_sent`` aliases they meet by their grams."""
    known = written(aliases.where("alias <> ''").groupBy("alias").agg(F.min("ord").alias("ord")), "aliases")
    different = written(names.select("name").where("name <> ''").distinct(), "names")
    exact = different.join(broadcast_if_small(known.select(F.col("alias").alias("name"))), "name", "left_semi").select("name", F.col("name").alias("alias"), F.lit(True).alias("exact"))
    rest = different.join(broadcast_if_small(known.select(F.col("alias").alias("name"))), "name", "left_anti")
    if known.limit(most_sent + 1).count() > most_sent:
        held = contains_join(known.select(F.col("alias"), "ord"), rest, "alias", "name")
        best = held.groupBy("name").agg(F.max_by("alias", F.struct(F.length("alias").alias("n"), (-F.col("ord")).alias("o"))).alias("alias"))
        return exact.unionByName(best.withColumn("exact", F.lit(False)))
    pairs = known.sparkSession.sparkContext.broadcast([(r.alias, r.ord) for r in known.collect()])  # most_sent at most

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for alias, order in pairs.value:
            automaton.add_word(alias, (len(alias), -order, alias))
        if pairs.value:
            automaton.make_automaton()
        for batch in batches:
            found = [(n, max(m for _, m in automaton.iter(n))[2]) for n in batch.column(0).to_pylist() if pairs.value and next(automaton.iter(n), None)]
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in found], pa.string()), pa.array([a for _, a in found], pa.string())], ["name", "alias"])

    return exact.unionByName(rest.mapInArrow(f, "name string, alias string").withColumn("exact", F.lit(False)))


def mapped_names(values: DataFrame, name: str, aliases: DataFrame, tests: DataFrame) -> DataFrame:
    """``values`` with canonical, target, confidence and mapped: by a whole alias (1.0), the longest alias inside (0.85), the first
    test whose name holds the name's first characters (0.8), else as it is (0.5). ``aliases`` is (alias, ord, canonical, target),
    ``tests`` (ord, test_name). Each different name is looked up once."""
    rows = values.withColumn("_clean", clean(F.col(name)))
    names = written(rows.select(F.col("_clean").alias("name")).distinct(), "clean-names")
    found = written(longest_alias(names, aliases.select("alias", "ord")), "aliased")
    meant = aliases.groupBy("alias").agg(F.min_by(F.struct("canonical", "target"), "ord").alias("_m"))
    by_alias = found.join(meant, "alias").select("name", F.col("_m.canonical").alias("canonical"), F.col("_m.target").alias("target"), F.when(F.col("exact"), 1.0).otherwise(0.85).alias("confidence"))
    left = written(names.join(found, "name", "left_anti").where("name <> ''").withColumn("_prefix", F.substring("name", 1, PREFIX)), "unaliased")
    labs = tests.select(F.col("ord").alias("_o"), "test_name", F.lower("test_name").alias("_l"))
    held = contains_join(left.select("_prefix").distinct(), labs, "_prefix", "_l").groupBy("_prefix").agg(F.min_by("test_name", "_o").alias("canonical"))
    by_test = left.join(held, "_prefix").select("name", "canonical", F.lit(None).cast("string").alias("target"), F.lit(0.8).alias("confidence"))
    known = by_alias.unionByName(by_test).withColumnRenamed("name", "_clean")
    out = rows.join(broadcast_if_small(written(known, "mapped")), "_clean", "left")
    return out.withColumns({"canonical": F.coalesce("canonical", F.col(name)), "mapped": F.col("confidence").isNotNull(), "confidence": F.coalesce("confidence", F.lit(0.5))}).drop("_clean")


def unit_factor(name: Column, unit: Column, target: Column) -> Column:
    """The factor from a unit to another: that of the exact key, 1 for equal units, else that of the first key that begins with
    the name and holds both units, else 1."""
    plain = lambda u: F.regexp_replace(F.lower(F.trim(F.coalesce(u, F.lit("")))), " ", "")
    a, b, n = plain(unit), plain(target), clean(name)
    key = F.concat(n, F.lit("_"), a, F.lit("->"), b)
    out = F.lit(1.0)
    for k, f in reversed(UNIT_FACTORS):
        out = F.when(F.lit(k).startswith(n) & F.lit(k).contains(a) & F.lit(k).contains(b), f).otherwise(out)
    out = F.when(a == b, 1.0).otherwise(out)
    for k, f in UNIT_FACTORS:
        out = F.when(key == k, f).otherwise(out)
    return out


def with_unit_factor(values: DataFrame, name: Column, unit: Column, target: Column) -> DataFrame:
    """``values`` with factor: ``unit_factor`` of each different (name, unit, target), looked up once and joined, nulls too."""
    keyed = values.withColumns({"_name": name, "_unit": unit, "_target": target})
    different = keyed.select("_name", "_unit", "_target").distinct()
    known = written(different.select(F.struct("_name", "_unit", "_target").alias("_k"), unit_factor(F.col("_name"), F.col("_unit"), F.col("_target")).alias("factor")), "factors")
    return keyed.join(broadcast_if_small(known), F.struct("_name", "_unit", "_target").eqNullSafe(F.col("_k")), "left").drop("_name", "_unit", "_target", "_k")
