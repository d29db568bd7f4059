"""Runs a query's SQL in DuckDB and compares rows."""

import math
from pathlib import Path

import duckdb


def views(sf: str, **frames):
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from read_parquet('{p}')")
    for name, frame in frames.items():
        con.sql(f"drop view if exists {name}")
        con.register(name, frame)
    return con


def same(df, sql: str, con) -> int:
    """The number of rows, after comparing all of them; doubles to within rounding."""
    rel = con.sql(sql)
    names = sorted(rel.columns)
    assert sorted(df.columns) == names
    order = [rel.columns.index(c) for c in names]
    key = lambda r: tuple((x is None, f"{x:.5f}" if isinstance(x, float) else str(x)) for x in r)
    want = sorted((tuple(r[i] for i in order) for r in rel.fetchall()), key=key)
    got = sorted((tuple(r[c] for c in names) for r in df.collect()), key=key)
    assert len(want) == len(got), (len(want), len(got))
    for a, b in zip(want, got, strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-9, abs_tol=2e-9)), (names, a, b)
    return len(got)
