"""Spark results against DuckDB results, as multisets of rows."""

from __future__ import annotations

from collections import Counter
from datetime import datetime
from decimal import Decimal

import duckdb

TABLES = ("events", "lineitem", "orders", "customer", "part", "supplier", "nation", "region")


def plain(value):
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, datetime):
        return value.replace(tzinfo=None)
    return value


def spark_rows(df) -> Counter:
    columns = sorted(df.columns)
    return Counter(tuple(plain(row[c]) for c in columns) for row in df.collect())


def duck_list(sql: str, sf_dir: str, events: str | None = None) -> tuple[list[str], list[tuple]]:
    """Column names in order and rows as they come; `events` may name other files for that table."""
    with duckdb.connect() as con:
        for table in TABLES:
            files = events if events and table == "events" else f"{sf_dir}/{table}.parquet"
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{files}')")
        result = con.sql(sql)
        order = sorted(range(len(result.columns)), key=lambda i: result.columns[i])
        return sorted(result.columns), [tuple(plain(row[i]) for i in order) for row in result.fetchall()]


def duck_rows(sql: str, sf_dir: str, events: str | None = None) -> tuple[list[str], Counter]:
    columns, rows = duck_list(sql, sf_dir, events)
    return columns, Counter(rows)


def plan_text(df) -> str:
    return df._jdf.queryExecution().toString()
