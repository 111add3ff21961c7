"""Clusters against plain whole-number k-means, and the heaps against comparing everything."""

import hashlib
import math
import random

import numpy as np
import pytest

from quillstone.llm import centroids

MOST = 1 << 27
SCHEMA = "vec_id long, embedding array<double>, label int, cluster string, _id int"


def whole(v):
    if v is None or len(v) != 64 or any(x is None or not math.isfinite(x) for x in v):
        return None
    return [MOST if 64 * x >= MOST else -MOST if 64 * x <= -MOST else math.floor(64 * x) for x in v]


def plain(rows, k=16, rounds=3):
    """(id, cluster, distance) of each kept row, and the centroids."""
    kept = [(i, x) for i, v, *_ in rows if (x := whole(v)) is not None]
    code = lambda i: hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    c = [x for _, _, x in sorted((code(i), x, x) for i, x in kept)[:k]]
    d = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b, strict=True))
    assign = lambda: [min(range(len(c)), key=lambda j: (d(x, c[j]), j)) for _, x in kept]
    for _ in range(rounds):
        own = assign()
        for j in range(len(c)):
            if m := [x for (_, x), o in zip(kept, own, strict=True) if o == j]:
                c[j] = [sum(col) // len(m) for col in zip(*m, strict=True)]
    return [(i, j, d(x, c[j])) for (i, x), j in zip(kept, assign(), strict=True)], c


def table(seed=1, n=300, spread=0.3):
    rng = np.random.default_rng(seed)
    centers = rng.standard_normal((12, 64))
    x = centers[rng.integers(0, 12, n)] + spread * rng.standard_normal((n, 64))
    rows = [(i, v.tolist(), 1, "c", 7) for i, v in enumerate(x)]
    rows += [(1000 + i, rows[3][1], 1, "c", 7) for i in range(40)]  # copies
    rows += [(4, rows[5][1], 1, "c", 7), (4, rows[5][1], 1, "c", 7), (None, rows[6][1], 1, "c", 7), (None, rows[7][1], 1, "c", 7)]
    odd = [None, [], [0.5] * 63, [0.5] * 65, [None, *[1.0] * 63], [float("nan"), *[1.0] * 63], [float("inf"), *[1.0] * 63], [0.0] * 64, [-0.0] * 64, [-1e-300] * 64, [1e-9] * 64, [3e5] * 64, [-1.7e308, *[1.7e308] * 63]]
    return rows + [(2000 + i, v, None, None, None) for i, v in enumerate(odd)]


def key(r):
    return tuple(map(str, r))


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_against_plain_rounds(spark, spread):
    rows = table(spread=spread)
    random.Random(1).shuffle(rows)
    want, c = plain(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = centroids.clustered(spark, df).collect()
    assert sorted([(r.vec_id, r.cluster, r.distance) for r in got], key=key) == sorted(want, key=key)
    total = sum(d for *_, d in want)
    of = {j: sum(d for _, o, d in want if o == j) for j in range(16)}
    most = 2**63 - 1
    for r in got:
        assert (r.cluster_inertia, r.inertia) == (min(of[r.cluster], most), min(total, most))
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, c[r.cluster])).encode()).hexdigest()


def test_few_vectors_and_none(spark):
    rows = [(1, [1.0] * 64, 0, "", 0), (2, [1.0] * 64, 0, "", 0), (3, [-2.0] * 64, 0, "", 0)]
    for n in (1, 2, 3):
        got = centroids.clustered(spark, spark.createDataFrame(rows[:n], SCHEMA)).collect()
        assert sorted((r.vec_id, r.cluster, r.distance) for r in got) == sorted(plain(rows[:n])[0])
    assert centroids.clustered(spark, spark.createDataFrame([(1, None, 0, "", 0)], SCHEMA)).collect() == []
    assert centroids.clustered(spark, spark.createDataFrame([], SCHEMA)).count() == 0


def test_heaps_spare_most_of_well_parted_vectors(spark):
    rng = np.random.default_rng(2)
    x = np.repeat(20 * rng.standard_normal((16, 64)), 60, axis=0) + 0.05 * rng.standard_normal((960, 64))
    df = spark.createDataFrame([(i, v.tolist(), 1, "", 0) for i, v in enumerate(x)], SCHEMA)
    found, c, compared = centroids.centroid_clusters(spark, df)
    want, centers = plain([(i, v.tolist()) for i, v in enumerate(x)])
    assert sorted((r.vec_id, r.cluster, r.distance) for r in found.collect()) == sorted(want) and c == centers
    assert compared[0] == 960 and compared[-1] < 320  # clumps that two first centroids share stay near


def test_blocks_settle_as_a_whole_comparison_would():
    rng = np.random.default_rng(4)
    x = rng.integers(-90, 90, (500, 8)).astype(np.int32)
    c, drift = rng.integers(-90, 90, (5, 8)).astype(np.int64), np.zeros(5)
    block = centroids.Block(x, 5)
    block.fill(c)
    count = block.delta.copy()
    for _ in range(12):
        new = c + rng.integers(-4, 5, c.shape)
        moves = np.sqrt(((new - c) ** 2).sum(1))
        drift = drift + moves + np.array([np.delete(moves, j).max() for j in range(5)])
        c = new
        block = centroids.Block.read(*block.written(), 5, 8)
        block.settle(c, drift)
        count += block.delta
        want = centroids.squared(x, c).argmin(1)
        assert (block.cluster == want).all()
        assert [int(n) for n in count[:, 0]] == np.bincount(want, minlength=5).tolist()
        assert all((count[j, 1:] == x[want == j].sum(0)).all() for j in range(5))
        assert sum(map(len, block.heaps)) == 500 and all(h[(i - 1) // 2] <= h[i] for h in block.heaps for i in range(1, len(h)))
