"""Compares a query with its DuckDB text on the given tables."""

from __future__ import annotations

from pathlib import Path

import duckdb

DATA = Path("/root/testdata/sf0.001")


def plain(v):
    if v is None:
        return "~"
    if isinstance(v, float):
        return repr(round(v, 5) + 0.0)
    return str(v)


def check(spark, query, sql: str, folder: Path = DATA) -> int:
    con = duckdb.connect()
    for p in folder.iterdir():
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    df = query(spark, str(folder))
    rel = con.sql(sql)
    assert sorted(df.columns) == sorted(rel.columns)
    cols = sorted(df.columns)
    ours = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    names = rel.columns
    theirs = sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in rel.fetchall())
    assert ours == theirs
    return len(ours)
