"""Compare a query's rows with DuckDB's."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return con


def _value(v):
    if v is None:
        return (0, "")
    if isinstance(v, bool):
        return (1, int(v))
    if isinstance(v, float) and math.isnan(v):
        return (2, "nan")
    return (1, round(float(v), 6)) if isinstance(v, (int, float)) or type(v).__name__ == "Decimal" else (3, str(v))


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted([tuple(_value(r[k]) for k in order) for r in rows], key=str)


def same(df, sql: str, sf_dir: str) -> int:
    """Fail unless both give the same columns and rows; returns their number."""
    rel = connect(sf_dir).sql(sql)
    want = rows_of(rel.columns, rel.fetchall())
    got = rows_of(df.columns, df.collect())
    assert sorted(df.columns) == sorted(rel.columns), (df.columns, rel.columns)
    assert len(got) == len(want), (len(got), len(want))
    for g, w in zip(got, want):
        assert g == w, (g, w)
    return len(got)
