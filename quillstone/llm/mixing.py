"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.llm.shared import WORD, Stage, as_struct, from_struct

#: Words of a block; hex digits of a place that cut a source into ranges for running totals; cells of the unit interval.
BLOCK_WORDS, PLACES, CELLS = 2048, 3, 4096
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2.0
GOLDEN = (math.sqrt(5) - 1) / 2


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None) -> DataFrame:
    """(row, rid, source, size, place): place orders a source's rows at random but alike in every run. ``row_col`` numbers the rows, if given."""
    size = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    return docs.select(row.alias("row"), F.col(id_col).cast("long").alias("rid"), F.col(source_col).cast("string").alias("source"), size.alias("size")).withColumn(
        "place", F.md5(F.coalesce(F.col("rid").cast("string"), F.lit("")))
    )


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, size) rows.

    Sources in code point order, null last, get the weights in turn. Targets are in proportion to them, but none above
    ``most`` times its source's size; what that leaves over is shared out again by weight. The fixed point of that is one
    level L with target = min(most * size, L * weight): in the order of size / weight, a source is at its cap if the level
    that sharing what is left among it and those after it would give is above its own. The table has a row per source,
    already summed.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), "source")
    by = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("weight", by).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    everything = Window.partitionBy(F.lit(1))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before, after = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    per = per.withColumn("_all", F.sum("source_size").over(everything) * F.lit(float(share)))
    per = per.withColumn("_level", (F.col("_all") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    first = F.when(F.col("_level") * F.col("weight") <= F.col("cap"), F.struct(F.row_number().over(fill).alias("n"), F.col("_level").alias("level")))
    per = per.withColumn("_first", first).withColumn("_level", F.min("_first").over(everything)["level"])
    target = F.least(F.col("cap"), F.coalesce(F.col("_level") * F.col("weight"), F.col("cap")))
    return per.select("source", "source_size", target.alias("target"), "weight")


def _prefix(rows: DataFrame, group: str, cut: str, order: list[Column | str], value: str, out: str) -> DataFrame:
    """Adds the exclusive running total of ``value`` in each ``group``, in the order of ``cut`` and then ``order``.

    Totals per (group, cut) first, then a window over each group's few cuts and one within each cut, so no task ever
    orders a whole group.
    """
    sums = rows.groupBy(group, cut).agg(F.sum(value).alias("_v"))
    before = Window.partitionBy(group).orderBy(cut).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col(group).alias("_g"), F.col(cut).alias("_c"), F.coalesce(F.sum("_v").over(before), F.lit(0)).alias("_before"))
    rows = rows.join(sums, F.col(group).eqNullSafe(F.col("_g")) & (F.col(cut) == F.col("_c")))
    inner = Window.partitionBy(group, cut).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(out, F.col("_before") + F.coalesce(F.sum(value).over(inner), F.lit(0))).drop("_g", "_c", "_before")


def slots_needed(goals: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(source, source_size, goal, blocks, slots): whole passes over all blocks, then as many blocks as hold the rest."""
    rounded = F.round("target").cast("long")
    blocks = F.ceil(F.col("source_size") / block_words)
    g = goals.select("source", "source_size", rounded.alias("goal"), F.greatest(blocks, F.lit(1)).cast("long").alias("blocks")).where("goal > 0 and source_size > 0")
    passes = F.floor(F.col("goal") / F.col("source_size"))
    rest = F.col("goal") - passes * F.col("source_size")
    return g.withColumn("slots", (passes * F.col("blocks") + F.ceil(rest / block_words)).cast("long"))


def schedule(spark: SparkSession, goals: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(slot, source, rank, block, epoch, words) of the mix, in the order of ``slot``.

    Slot n is the point frac((n + 1) * golden ratio), which falls into the source that covers it in the cumulative shares of the
    targets; a source's slots are ranked, and rank r takes the source's block r modulo its number of blocks. A source
    needs ceil(target / block) slots per pass over it, the last of them cut to what is missing, so what is taken is the target rounded.
    Points go on until every source has its slots: golden-ratio points are off by a few per source, whatever their number.
    """
    g = slots_needed(goals, block_words)
    order = Window.orderBy(F.col("source").isNull(), "source")
    everything = Window.partitionBy(F.lit(1))
    g = g.withColumn("_all", F.sum("slots").over(everything)).withColumn("hi", F.sum("slots").over(order.rowsBetween(Window.unboundedPreceding, 0)) / F.col("_all")).withColumn("lo", F.col("hi") - F.col("slots") / F.col("_all"))
    need = g.agg(F.max("_all"), F.count(F.lit(1))).first()
    total, sources = int(need[0] or 0), int(need[1])
    points = total + 8 * (sources + 1) * max(1, total.bit_length()) if total else 0
    # two factors keep the fractional part exact to 1e-12 for 10^13 slots
    n = F.col("slot") + 1
    u = ((F.floor(n / (1 << 20)) * F.lit((GOLDEN * (1 << 20)) % 1.0)) % 1.0 + ((n % (1 << 20)) * F.lit(GOLDEN)) % 1.0) % 1.0
    slots = spark.range(points).withColumnRenamed("id", "slot").withColumn("u", u).withColumn("cell", F.floor(F.col("u") * CELLS).cast("int"))
    cells = g.select("source", "source_size", "goal", "blocks", "slots", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * CELLS).cast("int"), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1)).cast("int"))).alias("cell"))
    placed = slots.join(cells, "cell").where("u >= lo and u < hi")
    placed = _prefix(placed.withColumn("one", F.lit(1)).withColumn("stretch", F.floor(F.col("slot") / F.lit(1 << 16))), "source", "stretch", ["slot"], "one", "rank")
    epoch = F.floor(F.col("rank") / F.col("blocks"))
    block = F.col("rank") - epoch * F.col("blocks")
    within = F.least(F.lit(block_words), F.col("source_size") - block * block_words)
    left = F.col("goal") - (epoch * F.col("source_size") + block * block_words)
    return placed.where("rank < slots").select("slot", "source", "rank", block.cast("long").alias("block"), epoch.cast("long").alias("epoch"), F.least(within, left).cast("long").alias("words"))


def mix(
    spark: SparkSession, docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, block_words: int = BLOCK_WORDS,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None,
) -> DataFrame:
    """One row per piece of a document and block: row (of ``docs``; ``row_col``, if given), rid, source, size, source_size, target, block, from and to (words of the
    document in the block), first (words of the block before it), and takes: an array of (slot, epoch, words the slot
    takes of the block from its start), empty where no slot takes the block.

    A source's documents in hashed order are one line of words, cut into blocks of ``block_words``; slots of the schedule
    take blocks in that order, so every document is taken before any is repeated and none more than ``most`` times (rounded
    up to whole passes of its words at most ``most``). Documents without words come with one piece of no words. Reruns agree.

    Null texts have size 0. Null sources are one source, the last. Null ids and repeated rows count as documents of
    their own with one place in the order (ties by size). An empty table gives no rows. Other columns are ignored.
    """
    stage = Stage(spark, "mix")
    rows = stage.cut(sized(docs, id_col, text_col, source_col, row_col), "sized")
    goals = stage.cut(targets(rows, weights, share, most), "targets")
    slots = stage.cut(schedule(spark, goals, block_words), "schedule")
    if slots.count() != (slots_needed(goals, block_words).agg(F.sum("slots")).first()[0] or 0):
        raise RuntimeError("a source got fewer points than it needs slots")
    lines = _prefix(rows.withColumn("stretch", F.substring("place", 1, PLACES)), "source", "stretch", ["place", "size", "row"], "size", "at")
    span = F.sequence(F.floor(F.col("at") / block_words), F.floor(F.greatest(F.col("at") + F.col("size") - 1, F.col("at")) / block_words))
    pieces = lines.select("row", "rid", "source", "size", "at", F.explode(span).alias("block"))
    start = F.greatest(F.col("at"), F.col("block") * block_words)
    end = F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * block_words)
    pieces = pieces.select("row", "rid", "source", "size", "block", (start - F.col("at")).alias("from"), (end - F.col("at")).alias("to"), (start - F.col("block") * block_words).alias("first"))
    takes = slots.groupBy("source", "block").agg(F.sort_array(F.collect_list(F.struct("slot", "epoch", "words"))).alias("takes"))  # at most ceil(most) a block
    taken = pieces.alias("p").join(takes.alias("t"), F.col("p.source").eqNullSafe(F.col("t.source")) & (F.col("p.block") == F.col("t.block")), "left").select("p.*", "takes")
    out = taken.join(F.broadcast(goals) if goals.count() <= 100_000 else goals, taken["source"].eqNullSafe(goals["source"])).select(taken["*"], "source_size", "target")
    empty = F.array().cast("array<struct<slot:bigint,epoch:bigint,words:bigint>>")
    return out.withColumn("takes", F.coalesce("takes", empty))


def taken_words() -> Column:
    """Words that all takes of a piece have of it."""
    one = lambda t: F.greatest(F.lit(0), F.least(F.col("to") - F.col("from"), t["words"] - F.col("first")))
    return F.aggregate("takes", F.lit(0).cast("long"), lambda s, t: s + one(t))


def mix_counts(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One row per row of ``docs``: its id, size, source_size, target and taken (words of it in the mix, repeats counted)."""
    pieces = mix(spark, docs, id_col=id_col, **options)
    per = pieces.groupBy("row", "rid", "size").agg(F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.sum(taken_words()).cast("long").alias("taken"))
    return per.select(F.col("rid").alias(id_col), "size", "source_size", "target", "taken")


def mixed_documents(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of ``docs`` that the mix takes, once per pass that takes any of their words; of a row that a source's last
    slot cuts, the text up to its last word taken (n_chars set). Columns as in ``docs``. Takes go back to rows by a number
    written with them, so rows with a null or repeated id each keep their own."""
    rows = Stage(spark, "mixed").cut(as_struct(docs, F.monotonically_increasing_id().alias("_row")), "rows")
    own = {c: F.col("_d").getField(c) for c in docs.columns}
    plain = rows.select("_row", own[id_col].alias("id"), own[text_col].alias("text"), own[source_col].alias("source"))
    pieces = mix(spark, plain, id_col="id", text_col="text", source_col="source", row_col="_row", **options)
    got = pieces.select(F.col("row").alias("_row"), "from", "to", "first", "size", F.explode("takes").alias("t"))
    got = got.withColumn("words", F.greatest(F.lit(0), F.least(F.col("to") - F.col("from"), F.col("t.words") - F.col("first"))))
    got = got.groupBy("_row", F.col("t.epoch").alias("_epoch")).agg(F.sum("words").alias("_words"), F.first("size").alias("_size")).where("_words > 0")
    out = rows.join(got, "_row").withColumn("_text", own[text_col])
    cut = F.expr("array_join(slice(filter(split(_text, '(?<=[\\\\x20\\\\x09-\\\\x0D])(?=[^\\\\x20\\\\x09-\\\\x0D])'), x -> x rlike '[^\\\\x20\\\\x09-\\\\x0D]'), 1, cast(_words as int)), '')")
    out = out.withColumn("_new", F.when(F.col("_words") < F.col("_size"), F.rtrim(cut)))
    new = {text_col: F.coalesce("_new", own[text_col])}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.coalesce(F.length("_new"), own["n_chars"])
    return from_struct(out, docs, new)
