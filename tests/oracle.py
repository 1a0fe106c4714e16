"""Runs a query and its SQL oracle over the same tables and compares the rows."""

import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if isinstance(v, decimal.Decimal):
        return int(v) if v == int(v) else float(v)
    return v


def _sorted(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


def check(spark, sf_dir, run, sql):
    df = run(spark, sf_dir)
    cols = sorted(df.columns)
    got = _sorted(tuple(_norm(r[c]) for c in cols) for r in df.collect())
    cur = connect(sf_dir).execute(sql)
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = _sorted(tuple(_norm(r[i]) for i in at) for r in cur.fetchall())
    assert got == want
    return len(got)
