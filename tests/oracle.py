"""Compares a query with its SQL on the same tables."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None:
        return ""
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return "" if v != v else repr(round(v, 9) + 0.0)
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int):
        return repr(round(float(v), 9) + 0.0)
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


def both(spark, sf_dir, query, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    df = query(spark, sf_dir)
    columns = sorted(df.columns)
    ours = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    result = con.sql(sql)
    assert sorted(result.columns) == columns
    at = [result.columns.index(c) for c in columns]
    theirs = sorted(tuple(plain(r[i]) for i in at) for r in result.fetchall())
    return ours, theirs
