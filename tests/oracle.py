"""Run a registered query on Spark and its SQL on DuckDB, and compare the rows."""

from __future__ import annotations

import decimal
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, int):
        return value
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def _sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return names, sorted(plain, key=repr)


def compare(spark, con, query, sql: str, folder: str) -> tuple[int, str | None]:
    """Row count, and a description of the first difference or None."""
    frame = query(spark, folder)
    names, ours = _sorted_rows(frame.columns, [tuple(r) for r in frame.collect()])
    cursor = con.execute(sql)
    columns = [c[0] for c in cursor.description]
    other, theirs = _sorted_rows(columns, cursor.fetchall())
    if names != other:
        return len(ours), f"columns {names} and {other}"
    if len(ours) != len(theirs):
        return len(ours), f"{len(ours)} and {len(theirs)} rows"
    for mine, their in zip(ours, theirs):
        if mine != their:
            return len(ours), f"{mine} and {their}"
    return len(ours), None
