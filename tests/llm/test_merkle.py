"""The manifest against a plain recursion, for several fanouts and partitions far smaller than the groups."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from quillstone.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, root int, _group string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(r, more=0):
    values = [r[0], r[3], r[2], None if r[4] is None else r[4] + more, r[1]]
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(nodes, fanout):
    """The root, and of each node its list of (place, siblings)."""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, a in enumerate(at):
            run = a - a % fanout
            proofs[i].append((a - run, nodes[run:a] + nodes[a + 1 : run + fanout]))
        nodes = [h(*nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]
        at = [a // fanout for a in at]
    return nodes[0], proofs


def manifest(rows, fanout):
    """(id, leaf, subroot, root, proof) of each row."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    below = {}
    for g in order:
        own = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        below[g] = (own, *tree([leaf_of(r) for r in own], fanout))
    root, above = tree([below[g][1] for g in order], fanout)
    return root, [(r, leaf_of(r), below[g][1], p + above[k]) for k, g in enumerate(order) for r, p in zip(below[g][0], below[g][2], strict=True)]


def up(leaf, proof):
    for place, siblings in proof:
        leaf = h(*siblings[:place], leaf, *siblings[place:])
    return leaf


def rows(seed=3):
    rnd = random.Random(seed)
    out = [(i, f"text {i} é" * (i % 3), "en" if i % 3 else rnd.choice(["de", "fr", "z", "Ä", ""]), f"s{i % 4}", i * 7, "x", 1, "g") for i in range(150)]
    out += [(200 + i, None, None, None, None, None, None, None) for i in range(5)]
    out += [(7, "other text of the same id", "en", "s1", 3, "x", 1, "g"), out[7], out[7], (None, "no id", "en", None, 9, "x", 1, "g"), (None, "no id", "en", None, 9, "x", 1, "g")]
    out += [(300, "long " * 200_000, "lone", "s", 1_000_000, "x", 1, "g"), (301, "", "en", "", 0, "x", 1, "g"), (-5, "below 0", "en", "s", -1, "x", 1, "g"), (302, "most", "en", "s", 2**63 - 1, "x", 1, "g")]
    return out


@pytest.mark.parametrize(("fanout", "leaves"), [(2, 4), (2, 1), (3, 9)])
def test_manifest(spark, fanout, leaves):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    leaf = merkle.digest(*map(F.col, ["doc_id", "source", "lang", "n_chars", "text"]))
    found = merkle.merkle_manifest(spark, df, leaf, fanout=fanout, leaves=leaves).withColumn("again", merkle.folded(F.col("leaf"), F.col("proof"))).collect()
    root, want = manifest(data, fanout)
    got = sorted((str(r.doc_id), r.leaf, r.subroot, [(s.place, list(s.siblings)) for s in r.proof]) for r in found)
    assert got == sorted((str(r[0]), leaf, sub, proof) for r, leaf, sub, proof in want)
    assert {r.root for r in found} == {r.again for r in found} == {root}
    assert {up(r.leaf, [(s.place, s.siblings) for s in r.proof]) for r in found} == {root}


def test_tampered_rows_are_found(spark):
    data = rows()
    root, want = manifest(data, 2)
    expected = []
    for r, leaf, sub, proof in want:
        told = leaf_of(r, int(r[4] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0))
        back = up(told, proof)
        expected.append((str(r[0]), leaf, sub, root, h(*[x for _, s in proof for x in s]), back, back == root))
    got = merkle.verified_manifest(spark, spark.createDataFrame(data, SCHEMA)).collect()
    assert sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in got) == sorted(expected)
    assert {r.verified for r in got} == {True, False}


def test_one_document_and_none(spark):
    df = spark.createDataFrame([(5, "a", "en", "s", 1, "x", 1, "g")], SCHEMA)
    r = merkle.verified_manifest(spark, df).first()
    assert r.leaf == r.subroot == r.root and r.proof_sha256 == h()
    assert merkle.verified_manifest(spark, df.limit(0)).count() == 0


def test_leaves_must_fit_the_fanout(spark):
    with pytest.raises(ValueError, match="power"):
        merkle.merkle_manifest(spark, spark.createDataFrame([], SCHEMA), F.lit("00"), fanout=3, leaves=8)
