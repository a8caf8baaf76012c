"""Compares a query's rows with DuckDB's."""

from __future__ import annotations

import math

import duckdb


def connect(sf_dir: str, tables) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in tables:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def _plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "null"
    if isinstance(x, bool):
        return str(x)
    try:
        return f"{float(x):.6g}" if abs(float(x)) < 1e6 else f"{float(x):.9g}"
    except (TypeError, ValueError):
        return str(x)


def rows(names, data) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in data)


def same(df, connection, sql: str) -> None:
    got = df.collect()
    cursor = connection.execute(sql)
    names = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, got) == rows(names, want)
