"""Runs a query and its SQL twin and compares their rows."""

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings exported_embedding stored_embedding "
    "exported_session exported_workspace semantic_search_result content_vectorizer_config mix_target"
).split()


def connect(folder):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return c


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, list | tuple):
        return tuple(norm(x) for x in v)
    return v


def same(spark, con, folder, query, sql):
    df = query(spark, folder)
    names = sorted(df.columns)
    mine = sorted(repr(tuple(norm(x) for x in r)) for r in df.select(*names).collect())
    r = con.execute(sql)
    cols = [d[0] for d in r.description]
    assert sorted(cols) == names
    at = [cols.index(n) for n in names]
    theirs = sorted(repr(tuple(norm(x[i]) for i in at)) for x in r.fetchall())
    assert mine == theirs
