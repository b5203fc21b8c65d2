"""Compares a query with its SQL in DuckDB on the same tables."""

import glob
import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        if glob.glob(p):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def _value(v):
    if v is None or (not hasattr(v, "__len__") and pd.isna(v)):
        return None
    if hasattr(v, "__iter__") and not isinstance(v, str):
        return tuple(_value(x) for x in v)
    if isinstance(v, pd.Timestamp):
        return v.tz_localize(None).isoformat() if v.tzinfo else v.isoformat()
    if hasattr(v, "item"):
        v = v.item()
    return round(float(v), 7) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


def rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted((tuple(_value(v) for v in r) for r in pdf[cols].itertuples(index=False)), key=repr)


def same(spark, sf, name, queries, sql):
    got = rows(queries[name](spark, sf).toPandas())
    want = rows(connect(sf).sql(sql[name]).df())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]
