"""Rows of a Spark query against the rows of its SQL in DuckDB."""

import datetime
import decimal
import math

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def rows_equal(df, sql, sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    cols = sorted(df.columns)
    got = sorted((tuple(normal(r[c]) for c in cols) for r in df.collect()), key=repr)
    out = con.execute(sql)
    names = [d[0] for d in out.description]
    assert sorted(names) == cols
    want = sorted((tuple(normal(r[names.index(c)]) for c in cols) for r in out.fetchall()), key=repr)
    assert got == want
    return len(got)
