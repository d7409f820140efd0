"""A Spark result against DuckDB's, as multisets of rows by column name."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _value(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    return repr(round(v, 9)) if isinstance(v, float) else str(v)


def connect(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"create view {t} as select * from read_parquet('{p if os.path.isfile(p) else p + '/*.parquet'}')")
    return c


def rows(names, values):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(names), sorted(tuple(_value(v[k]) for k in order) for v in values)


def compare(spark, sf_dir, query, sql):
    df = query(spark, sf_dir)
    mine = rows(df.columns, df.collect())
    r = connect(sf_dir).execute(sql)
    assert mine == rows([x[0] for x in r.description], r.fetchall())
