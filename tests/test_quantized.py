"""The kept vector index: recall and share of codes on planted clusters, slabs, readers, odd vectors."""

import numpy as np
import pytest

from quillstone.operators.quantized import PARTS, ProductIndex, hashed_vectors, spot_check
from quillstone.operators.vectors import exact_topk


def planted(n=6000, d=32, groups=120, seed=4):
    rng = np.random.default_rng(seed)
    centers = rng.standard_normal((groups, d)) * 3
    x = centers[rng.integers(0, groups, n)] + 0.4 * rng.standard_normal((n, d))
    return x / np.linalg.norm(x, axis=1)[:, None]


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(planted())], "vec_id long, embedding array<double>").repartition(6).cache()


def rows(index, vectors, **options):
    return sorted((r.query_id, r["rank"], r.item_id, round(r.score, 9)) for r in index.search(vectors.where("vec_id % 20 = 0"), 10, **options).collect())


def test_recall_with_few_codes(spark, vectors, tmp_path):
    """On vectors that cluster, nine tenths of the exact hits are found with under a tenth of the codes, 16 bytes each."""
    index = ProductIndex.fit(spark, vectors, str(tmp_path), cells=128, sample=4000)
    assert index.append("all", vectors)
    asked = vectors.where("vec_id % 20 = 0")
    exact = exact_topk(spark, asked, vectors, 10).select("query_id", "item_id")
    checked = spot_check(index, exact, asked, 10, nprobe=6).toPandas()
    assert len(checked) == 300 and checked["recall"].mean() >= 0.9 and checked["scanned"].mean() < 0.1 * 6000
    codes = spark.read.parquet(f"{tmp_path}/codes/all")
    assert {len(r.code) for r in codes.select("code").distinct().limit(50).collect()} == {PARTS} and codes.count() == 6000


def test_slabs(spark, vectors, tmp_path):
    """Two appends and a repeated one are one build; a slab that was begun and not entered isn't read, and is written anew."""
    few = vectors.where("vec_id < 1500")
    whole = ProductIndex.fit(spark, few, str(tmp_path / "a"), cells=32, seed=3)
    whole.append("all", few)
    parts = ProductIndex.fit(spark, few, str(tmp_path / "b"), cells=32, seed=3)
    assert rows(parts, few) == [] and parts.slabs() == set()
    assert parts.append("one", few.where("vec_id % 3 = 0"))
    assert {i % 3 for _, _, i, _ in rows(parts, few)} == {0}
    half = few.where("vec_id % 3 = 1")
    half.limit(7).selectExpr("vec_id as id", "0 as cell", "cast('x' as binary) as code").write.parquet(str(tmp_path / "b/codes/two"))
    assert {i % 3 for _, _, i, _ in rows(parts, few)} == {0}  # readers see no slab without its entry
    assert parts.append("two", few.where("vec_id % 3 > 0")) and not parts.append("two", few)
    assert ProductIndex(spark, str(tmp_path / "b")).slabs() == {"one", "two"}
    assert rows(ProductIndex(spark, str(tmp_path / "b")), few, nprobe=32, again=200) == rows(whole, few, nprobe=32, again=200)
    with pytest.raises(ValueError, match="name"):
        parts.append("../x", few)


def test_odd_vectors(spark, tmp_path):
    good = [(i, [float(i % 5), 1.0, float(i % 3), 2.0]) for i in range(40)]
    odd = [(100, None), (101, []), (102, [1.0]), (103, [1.0, None, 1.0, 1.0]), (104, [float("nan")] * 4), (105, [float("inf")] * 4), (None, [1.0] * 4), (7, good[7][1])]
    df = spark.createDataFrame(good + odd, "vec_id long, embedding array<double>")
    index = ProductIndex.fit(spark, df, str(tmp_path), cells=4, parts=2)
    index.append("s", df)
    found = index.search(df, 3, nprobe=4, again=40).collect()
    assert {r.query_id for r in found} == set(range(40)) and {r.item_id for r in found} <= set(range(40))
    exact = {(r.query_id, r["rank"]): r.score for r in exact_topk(spark, df.where("vec_id < 40"), df.where("vec_id < 40").dropDuplicates(["vec_id"]), 1).collect()}
    assert all(abs(exact[r.query_id, 1] - r.score) < 1e-9 for r in found if r["rank"] == 1)
    assert index.search(df.limit(0), 3).count() == 0
    with pytest.raises(ValueError, match="needs vectors"):
        ProductIndex.fit(spark, df.limit(0), str(tmp_path / "none"))


def test_hashed_vectors(spark):
    df = spark.createDataFrame([(1, "a b b"), (2, "A B b"), (3, ""), (4, None), (5, "...")], "doc_id long, text string")
    got = {r.id: r.vector for r in hashed_vectors(df).collect()}
    assert set(got) == {1, 2} and got[1] == got[2] and abs(sum(x * x for x in got[1]) - 1) < 1e-12


def test_recall_holds_as_the_index_grows(spark, tmp_path):
    """Vectors without clusters, whose codes say little: of more items a given number of candidates held fewer and fewer of the hits."""
    x = np.random.default_rng(8).standard_normal((12000, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(6)
    asked = df.where("vec_id % 100 = 0")
    recall = []
    for n in (3000, 12000):
        few = df.where(f"vec_id < {n}")
        index = ProductIndex.fit(spark, few, str(tmp_path / str(n)), cells=8, parts=4, sample=3000)
        index.append("all", few)
        exact = exact_topk(spark, asked, few, 10).select("query_id", "item_id")
        recall.append(spot_check(index, exact, asked, 10, nprobe=8, again=10).toPandas()["recall"].mean())
    assert min(recall) >= 0.9, recall


def test_copies_are_first_by_id(spark, tmp_path):
    """More copies of a vector than candidates: the smallest ids are found, as exact search finds them."""
    x = np.random.default_rng(9).standard_normal((400, 16))
    rows_ = [(i, x[i % 400].tolist()) for i in range(400)] + [(400 + i, x[7].tolist()) for i in range(2000)]
    df = spark.createDataFrame(rows_, "vec_id long, embedding array<double>").repartition(5)
    index = ProductIndex.fit(spark, df, str(tmp_path), cells=2, parts=4, sample=1000)
    index.append("all", df)
    found = index.search(df.where("vec_id = 7"), 5, nprobe=2, again=4)
    assert [r.item_id for r in found.orderBy("rank").collect()] == [7, 400, 401, 402, 403] and found.first().scanned == 2400


def test_vectors_and_codes_are_made_in_parallel(spark, vectors, tmp_path):
    """No row for each word, a text's length is computed once, and subspaces' codes don't all come from one task."""
    docs = spark.createDataFrame([(i, f"w{i} w{i % 7} of") for i in range(50)] + [(3, "w3 again"), (60, "")], "doc_id long, text string").repartition(3)
    plan = hashed_vectors(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and plan.count("SQRT") <= 2
    got = {r.id: r.vector for r in hashed_vectors(docs).collect()}
    assert set(got) == set(range(50)) and got[3] == {r.id: r.vector for r in hashed_vectors(spark.createDataFrame([(3, "w3 w3 of w3 again")], "doc_id long, text string")).collect()}[3]
    ProductIndex.fit(spark, vectors.limit(600), str(tmp_path), cells=4)
    assert len(list((tmp_path / "quantiser").glob("*.parquet"))) > 2
