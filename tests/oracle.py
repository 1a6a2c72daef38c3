"""Compares a query with its SQL in DuckDB on the test tables."""

import os

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def rows(df):
    def plain(v):
        if v is None or (not isinstance(v, (str, list)) and pd.isna(v)):
            return "~"
        return repr(float(v)) if isinstance(v, (int, float, np.number)) and not isinstance(v, (bool, np.bool_)) else str(v)

    return sorted(tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


def same(spark, sf_dir, query, sql):
    a, b = query(spark, sf_dir).toPandas(), connect(sf_dir).execute(sql).fetch_df()
    assert sorted(a.columns) == sorted(b.columns)
    assert rows(a) == rows(b)
