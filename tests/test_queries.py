import pytest

from quillstone.plans import library
from tests.oracle import both

SQL = library.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_sql(spark, sf_dir, name):
    ours, theirs = both(spark, sf_dir, library.queries()[name], SQL[name])
    assert len(ours) == len(theirs)
    assert ours == theirs


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and df.columns


def test_cell_index_recall(spark, sf_dir):
    q = library.queries()
    exact = {(r.query_id, r.item_id) for r in q["vector_topk"](spark, sf_dir).collect()}
    found = {(r.query_id, r.item_id) for r in q["ivf_topk"](spark, sf_dir).collect()}
    assert len(exact & found) >= 0.9 * len(exact)
