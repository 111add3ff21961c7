"""A Merkle manifest of a dataset: leaves, roots and proofs, with upper proofs by a butterfly exchange of partitions."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.shared import Stage, arrow_map, broadcast_if_small

#: Children of a node, and leaves of a partition of the exchange (a power of the fanout).
FANOUT, LEAVES = 2, 1024
#: One level of a proof: the node's place in its run, and the run's other digests from left to right.
_STEP = "struct<place: int, siblings: array<string>>"


def joined(*values: Column) -> Column:
    """Values as one text: `-` for null, else UTF-8 bytes, `:`, value."""
    texts = [v.cast("string") for v in values]
    return F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def digest(*values: Column) -> Column:
    """Lowercase hex SHA-256 of the values joined."""
    return F.sha2(joined(*values).cast("binary"), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof give."""

    def up(h: Column, step: Column) -> Column:
        before, after = F.slice(step.siblings, F.lit(1), step.place), F.slice(step.siblings, step.place + 1, F.size(step.siblings))
        return F.sha2(F.concat(F.array_join(before, ""), h, F.array_join(after, "")).cast("binary"), 256)

    return F.aggregate(proof, leaf, up)


def siblings(proof: Column) -> Column:
    """All digests of a proof from the leaf's level to the root's, as one text."""
    return F.array_join(F.flatten(F.transform(proof, lambda step: step.siblings)), "")


def _h(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _levels(leaves: list[str], fanout: int, height: int) -> list[list[str]]:
    """The nodes of each level above some leaves: ``height`` levels, or up to a single node if that is less than 0."""
    levels = [leaves]
    while len(levels) <= height if height >= 0 else len(levels[-1]) > 1:
        low = levels[-1]
        levels.append([_h(low[i : i + fanout]) for i in range(0, len(low), fanout)])
    return levels


def _steps(level: list[str], fanout: int) -> list[tuple[int, list[str]]]:
    """The step of each node of a level to the next."""
    out = []
    for i in range(len(level)):
        run = i - i % fanout
        out.append((i - run, level[run:i] + level[i + 1 : run + fanout]))
    return out


def _height(leaves: int, fanout: int) -> int:
    h = 0
    while fanout**h < leaves:
        h += 1
    if fanout < 2 or fanout**h != leaves:
        raise ValueError("leaves of a partition must be a power of the fanout, which is 2 or more")
    return h


def _numbered(leaves: DataFrame, stage: Stage, name: str) -> DataFrame:
    """Each leaf's place in its group (_at) and the group's size (_n): ranges of the order are numbered apart, then moved by
    the sizes of those before. The order is by group, id (nulls first) and leaf."""
    order = ["_group", "_id", "_leaf"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, last, n = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            places = []
            for g in batch.column("_group").to_pylist():
                last, n = g, n + 1 if g == last else 0
                places.append(n)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([part] * len(places), pa.int32()), pa.array(places, pa.int64())], [*batch.schema.names, "_range", "_place"]
            )

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in leaves.schema.fields)
    ranges = leaves.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(each, f"{kinds}, _range int, _place long")
    ranges = stage.cut(ranges, f"{name}-ranges")
    sizes = ranges.groupBy("_group", "_range").agg(F.count(F.lit(1)).alias("_c"), F.min(F.struct("_id", "_leaf")).alias("_first"))
    before = F.expr("coalesce(sum(_c) over (partition by _group order by _first rows between unbounded preceding and 1 preceding), 0)")
    starts = sizes.select("_group", "_range", before.alias("_start"), F.expr("sum(_c) over (partition by _group)").alias("_n"))
    starts = stage.cut(starts, f"{name}-starts")
    found = ranges.join(broadcast_if_small(starts, starts.count()), ["_group", "_range"])
    return found.withColumn("_at", F.col("_start") + F.col("_place")).drop("_range", "_place", "_start")


def _exchanged(parts: DataFrame, stage: Stage, name: str, fanout: int) -> DataFrame:
    """Butterfly over (_group, _part, _parts, node): in round r the partitions of an aligned group of fanout^(r+1) whose
    numbers differ in digit r alone swap the roots that they hold, and each hashes their parent for itself. Adds _path.

    A partner past the end is replaced by the last partition if its subtree has any. Runs end at each group's end."""
    state = parts.withColumn("_path", F.array().cast(f"array<{_STEP}>"))
    most = state.agg(F.max("_parts")).first()[0] or 0
    span, held = 1, None
    while span < most:
        start = F.floor(F.col("_part") / (span * fanout)) * (span * fanout)
        own = F.floor(F.col("_part") / span) % fanout
        asks = state.where(F.col("_parts") > span).select("_group", "_part", "_parts", start.alias("_s"), F.explode(F.sequence(F.lit(0), F.lit(fanout - 1))).alias("_k"))
        asks = asks.where(F.col("_s") + F.col("_k") * span < F.col("_parts"))
        partner = F.least(F.col("_s") + F.col("_k") * span + F.col("_part") % span, F.col("_parts") - 1)
        given = state.select("_group", F.col("_part").alias("_partner"), F.col("node").alias("_given"))
        got = asks.select("_group", "_part", "_k", partner.alias("_partner")).join(given, ["_group", "_partner"])
        got = got.groupBy("_group", "_part").agg(F.array_sort(F.collect_list(F.struct("_k", "_given"))).alias("_run"))
        swapped = state.join(got, ["_group", "_part"], "left")
        run = F.transform("_run", lambda x: x["_given"])
        others = F.transform(F.filter("_run", lambda x: x["_k"] != own), lambda x: x["_given"])
        step = F.struct(own.cast("int").alias("place"), others.alias("siblings")).cast(_STEP)
        done = F.col("_run").isNull()
        state = stage.cut(
            swapped.select(
                "_group", "_part", "_parts",
                F.when(done, F.col("node")).otherwise(F.sha2(F.array_join(run, "").cast("binary"), 256)).alias("node"),
                F.when(done, F.col("_path")).otherwise(F.concat("_path", F.array(step))).alias("_path"),
            ),
            f"{name}-round-{span}",
        )
        if held:
            stage.drop(held)
        held, span = f"{name}-round-{span}", span * fanout
    return state


def _trees(leaves: DataFrame, stage: Stage, name: str, fanout: int, size: int) -> tuple[DataFrame, DataFrame]:
    """Of leaves (_group, _id, _leaf binary, _kept): partitions (_group, _part, _n, _rows) of up to ``size`` leaves in order, and what each holds
    after the exchange: (_group, _part, node: the group's root, _path: the proof from the partition's root)."""
    height = _height(size, fanout)
    placed = _numbered(leaves, stage, name)
    placed = placed.withColumn("_part", F.floor(F.col("_at") / size))
    rows = placed.groupBy("_group", "_part", "_n").agg(F.array_sort(F.collect_list(F.struct("_at", "_id", "_leaf", "_kept"))).alias("_rows"))

    def roots(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        lists, n = batch.column("_rows"), batch.column("_n").to_pylist()
        out = []
        for i in range(batch.num_rows):
            own = [x.hex() for x in lists[i].values.field("_leaf").to_pylist()]
            out.append(_levels(own, fanout, height if n[i] > size else -1)[-1][0])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], [*batch.schema.names, "node"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    rows = stage.cut(arrow_map(rows, roots, f"{kinds}, node string"), f"{name}-partitions")
    parts = rows.select("_group", "_part", F.ceil(F.col("_n") / size).cast("long").alias("_parts"), "node")
    return rows.drop("node"), _exchanged(parts, stage, name, fanout)


def _proofs(rows: DataFrame, tops: DataFrame, fanout: int, size: int) -> DataFrame:
    """The leaves of each partition with their proofs: each task hashes its partitions' own levels again and adds the path that they hold."""
    height = _height(size, fanout)
    schema = rows.schema["_rows"].dataType.elementType

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        step = pa.struct([("place", pa.int32()), ("siblings", pa.list_(pa.string()))])
        n, subroots, roots = (batch.column(c).to_pylist() for c in ("_n", "subroot", "root"))
        for i in range(batch.num_rows):
            values = batch.column("_rows")[i].values
            own = [x.hex() for x in values.field("_leaf").to_pylist()]
            levels = _levels(own, fanout, height if n[i] > size else -1)
            below = [_steps(level, fanout) for level in levels[:-1]]
            above = [(x["place"], x["siblings"]) for x in batch.column("_path")[i].as_py()]
            proofs = [[s[j // fanout**k] for k, s in enumerate(below)] + above for j in range(len(own))]
            columns = [values.field("_id"), values.field("_kept"), pa.array(own), pa.array([subroots[i]] * len(own)), pa.array([roots[i]] * len(own)), pa.array(proofs, pa.list_(step))]
            yield pa.RecordBatch.from_arrays(columns, ["_id", "_kept", "leaf", "subroot", "root", "proof"])

    kinds = f"_id {schema['_id'].dataType.simpleString()}, _kept {schema['_kept'].dataType.simpleString()}"
    both = rows.join(broadcast_if_small(tops, tops.count(), 100_000), ["_group", "_part"])
    return arrow_map(both, each, f"{kinds}, leaf string, subroot string, root string, proof array<{_STEP}>")


def merkle_manifest(
    spark: SparkSession, docs: DataFrame, leaf: Column, id_col: str = "doc_id", group_col: str = "lang", keep: dict[str, Column] | None = None, fanout: int = FANOUT, leaves: int = LEAVES
) -> DataFrame:
    """One row per row of ``docs``: the id, the columns of ``keep``, leaf, subroot (of its group), root, and proof: a list of
    (place, siblings) from the leaf's level to the root's, which ``folded`` takes back to the root.

    ``leaf`` is a hex digest. Each group's leaves ascend by id; runs of ``fanout`` nodes become one until one is left. The
    groups' subroots, ascending with null first, likewise give the root. A group of one leaf has it as its subroot.

    Partitions are aligned runs of ``leaves`` leaves of one group, so a group of any size is in many tasks. A table of a row
    per partition goes through log(partitions) rounds of the exchange, each one equi-join; leaves are read twice and
    hashed twice, and no pass leads downwards. Texts are read once, of any length, and not shuffled.

    A null group is a group of its own, before the others. Null ids come first. Rows of equal ids are ordered by leaf;
    repeated rows are leaves of their own, with proofs of their own. An empty table gives no rows. Other columns, also of
    clashing names, are ignored.
    """
    stage = Stage(spark, "merkle")
    group = F.coalesce(F.concat(F.lit("1"), F.col(f"`{group_col}`").cast("string")), F.lit("0"))
    kept = F.struct(*[v.alias(k) for k, v in (keep or {}).items()], F.lit(True).alias("_"))
    found = stage.cut(docs.select(group.alias("_group"), F.col(f"`{id_col}`").alias("_id"), F.unhex(leaf).alias("_leaf"), kept.alias("_kept")), "leaves")
    rows, tops = _trees(found, stage, "group", fanout, leaves)
    tops = tops.withColumnRenamed("node", "subroot")
    groups = tops.where("_part = 0").select(F.lit("").alias("_group"), F.col("_group").alias("_id"), F.unhex("subroot").alias("_leaf"), F.struct(F.lit(True).alias("_")).alias("_kept"))
    upper, top = _trees(groups, stage, "root", fanout, leaves)
    upper = _proofs(upper, top.select("_group", "_part", "_path", F.col("node").alias("subroot"), F.col("node").alias("root")), fanout, leaves)
    upper = stage.cut(upper.select(F.col("_id").alias("_group"), "root", F.col("proof").alias("_above")), "upper")
    tops = tops.join(broadcast_if_small(upper, upper.count(), 100_000), "_group")
    tops = stage.cut(tops.select("_group", "_part", "subroot", "root", F.concat("_path", "_above").alias("_path")), "tops")
    out = _proofs(rows, tops, fanout, leaves)
    return out.select(F.col("_id").alias(id_col), *[F.col("_kept").getField(k).alias(k) for k in keep or {}], "leaf", "subroot", "root", "proof")


def verified_manifest(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The manifest of documents by lang, with each document's proof folded from a leaf of which some were tampered with.

    Tampering adds 1 to n_chars where 7 divides the unsigned crc32 of the decimal id; a null n_chars stays, and null ids
    are not tampered with."""
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    chars = F.col("n_chars").cast("decimal(20,0)") + 1
    told = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, digest(*[chars if c == "n_chars" else F.col(c) for c in columns]))
    found = merkle_manifest(spark, docs, digest(*map(F.col, columns)), keep={"told": told})
    back = folded(F.coalesce("told", "leaf"), F.col("proof"))
    out = found.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("proof")).cast("binary"), 256).alias("proof_sha256"), back.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
