"""Compares a query with its oracle: columns, row count and values, whatever the row order."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

from workload.inputs import TABLES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    """A database in this process with the given tables as views."""
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def canonical(value: object) -> object:
    """A value in the form both engines agree on."""
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (int, decimal.Decimal)):
        return float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.12g}")
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(canonical(v) for v in value)
    return str(value)


def rows_of(columns: list[str], rows: list[tuple]) -> list[tuple]:
    """Rows with columns in name order, sorted."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(canonical(r[i]) for i in order) for r in rows), key=repr)


def difference(df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """What differs between a frame and its oracle, or None."""
    theirs = con.execute(sql)
    names = [d[0] for d in theirs.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    kinds = dict(zip(names, (str(d[1]) for d in theirs.description)))
    expected = rows_of(names, theirs.fetchall())
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if len(got) != len(expected):
        return f"{len(got)} rows, expected {len(expected)}; first {got[:2]} / {expected[:2]}"
    for mine, other in zip(got, expected):
        if mine != other:
            return f"{mine} instead of {other} (columns {sorted(names)})"
    families = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP"}
    for name, kind in df.dtypes:
        if kind in families and kinds[name] not in (families[kind], '"NULL"', families[kind] + "_NS"):
            return f"type of {name}: {kind} and {kinds[name]}"
    return None
