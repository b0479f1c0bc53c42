"""Runs a query and its DuckDB twin on the same tables and compares rows, regardless of order."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def norm(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}") + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(norm(y) for y in x)
    return x


def same(df, sql: str, sf: str) -> int:
    """Asserts equality; the number of rows."""
    rel = duck(sf).execute(sql)
    names = [d[0] for d in rel.description]
    assert sorted(names) == sorted(df.columns), (sorted(names), sorted(df.columns))
    want = [tuple(norm(r[names.index(c)]) for c in df.columns) for r in rel.fetchall()]
    got = [tuple(norm(x) for x in r) for r in df.collect()]
    key = lambda r: tuple((x is None, str(type(x)), x) if not isinstance(x, (bool, type(None))) else (x is None, "", str(x)) for x in r)
    want, got = sorted(want, key=key), sorted(got, key=key)
    assert len(want) == len(got), (len(got), len(want))
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    assert not bad, (len(bad), df.columns, bad[:3])
    return len(got)
