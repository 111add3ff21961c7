"""Searches with more queries than a block: the same hits, in bounded memory, and no row for a pair that is no hit."""

import tracemalloc

import numpy as np
import pandas as pd

from quillstone.operators import vectors
from quillstone.operators.quantized import ProductIndex
from quillstone.operators.vectors import CellIndex, exact_topk


def frame(spark, n, d=8, seed=2):
    x = np.random.default_rng(seed).integers(-3, 4, (n, d))  # whole numbers, so that there are ties
    return spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)


def rows(df):
    return sorted((r.query_id, r["rank"], r.item_id, r.score) for r in df.collect())


def test_product_search_in_blocks(spark, tmp_path):
    df = frame(spark, 900)
    index = ProductIndex.fit(spark, df, str(tmp_path), cells=8, parts=4)
    index.append("s", df)
    whole = index.search(df, 5, nprobe=8, again=40)
    parts = index.search(df, 5, nprobe=8, again=40, block=100)
    assert rows(parts) == rows(whole) and len(rows(whole)) == 4500
    assert {r.scanned for r in parts.collect()} == {900}


def test_cells_in_blocks(spark):
    df = frame(spark, 600)
    index = CellIndex.fit(spark, df, cells=4)
    found = index.search(df.where("vec_id % 3 = 0"), 5, nprobe=4, block=30)
    assert rows(found) == rows(index.search(df.where("vec_id % 3 = 0"), 5, nprobe=4)) == rows(exact_topk(spark, df.where("vec_id % 3 = 0"), df, 5))
    assert "Join" not in found._jdf.queryExecution().toString()  # a join made a row for each pair


def test_memory_of_many_queries():
    rng = np.random.default_rng(1)
    q, x = rng.standard_normal((6000, 4)), rng.standard_normal((9000, 4))
    best = vectors._Best(pd.DataFrame({"query_id": np.arange(6000), "v": list(q)}), 10)
    items = pd.DataFrame({"id": np.arange(9000), "v": list(x)})
    tracemalloc.start()
    best.take(items)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80e6  # the scores of one part of the items with all queries are 98 MB
    got = pd.concat(best.frames())
    for i in (0, 1024, 5999):
        assert got[got["query_id"] == i]["item_id"].tolist() == np.argsort(-(x @ q[i]), kind="stable")[:10].tolist()


def test_rough_scores_in_single_precision(monkeypatch):
    """All pairs are met in single precision where lengths allow it; what may count is made anew, so near ties and equal vectors keep their order."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((3000, 16))
    x[100:140] = x[100] * (1 + 1e-12 * np.arange(40)[::-1, None])  # no two differ in single precision
    x[200:230] = x[2500:2530] = x[200]
    kinds, take = [], vectors._Tile.take

    def seen(self, places, ids, rough, *rest):
        kinds.append(rough.dtype)
        return take(self, places, ids, rough, *rest)

    monkeypatch.setattr(vectors._Tile, "take", seen)
    for scale, kind in ((1.0, np.float32), (1e20, np.float64)):
        q = np.stack([x[100], x[200], -x[100]])
        best = vectors._Best(pd.DataFrame({"query_id": np.arange(3), "v": list(q)}), 20)
        best.take(pd.DataFrame({"id": np.arange(3000), "v": list(x * scale)}))
        got = pd.concat(best.frames())
        score = np.array([[sum(a * b for a, b in zip(u, v, strict=True)) for v in x] for u in q])
        assert set(kinds) == {np.dtype(kind)}
        for i in range(2):
            assert got[got["query_id"] == i]["item_id"].tolist() == np.lexsort((np.arange(3000), -score[i].round(14)))[:20].tolist()
        kinds.clear()
