"""Compares a query with its SQL, as multisets of rows."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(path):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{path}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, list | tuple):
        return tuple(norm(x) for x in v)
    return v


def same(spark, path, query, sql):
    df = query(spark, path)
    columns = sorted(df.columns)
    mine = sorted(repr([norm(r[c]) for c in columns]) for r in df.collect())
    with connect(path) as con:
        found = con.sql(sql)
        assert sorted(found.columns) == columns
        at = [found.columns.index(c) for c in columns]
        theirs = sorted(repr([norm(r[k]) for k in at]) for r in found.fetchall())
    assert mine == theirs
