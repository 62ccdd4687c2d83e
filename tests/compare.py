"""Rows of a Spark query against those of its SQL in DuckDB."""

import math
from pathlib import Path

import duckdb

TABLES = [p.stem for p in Path("/root/testdata/sf0.001").glob("*.parquet")]


def connect(root):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{root}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if type(v).__name__ == "Decimal":
        return plain(float(v))
    return v


def same(df, sql, root):
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)
    run = connect(root).execute(sql)
    columns = [x[0] for x in run.description]
    assert sorted(columns) == names
    at = [columns.index(n) for n in names]
    want = sorted((tuple(plain(r[i]) for i in at) for r in run.fetchall()), key=repr)
    assert got == want
    return len(got)
