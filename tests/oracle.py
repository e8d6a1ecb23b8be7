"""Compares a query's rows with its DuckDB twin's, regardless of order."""

from __future__ import annotations

import math
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    db.sql("set TimeZone = 'UTC'")
    for name in sorted(os.listdir(sf_dir)):
        db.sql(f"create view {name.partition('.')[0]} as select * from '{sf_dir}/{name}'")
    return db


def _plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "NULL"
    if isinstance(value, bool):
        return str(value)
    try:
        return f"{round(float(value), 6):.6f}"
    except (TypeError, ValueError):
        return str(getattr(value, "replace", lambda **_: value)(tzinfo=None) if hasattr(value, "tzinfo") else value)


def rows(columns: list[str], values: list[tuple]) -> list[tuple[str, ...]]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(_plain(row[i]) for i in order) for row in values)


def same(df, db: duckdb.DuckDBPyConnection, sql: str) -> None:
    twin = db.sql(sql)
    assert sorted(df.columns) == sorted(twin.columns)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    want = rows(twin.columns, twin.fetchall())
    assert len(got) == len(want)
    assert got == want
