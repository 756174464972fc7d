"""Compare a Spark result with DuckDB's on the same tables, whatever the order of rows and columns."""

from __future__ import annotations

import math
import os

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        path = f"{sf_dir}/{name}"
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{path}{'/*' if os.path.isdir(path) else ''}')")
    return con


def canonical(value):
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        value = float(value)
        return "nan" if math.isnan(value) else f"{value:.6g}"
    return str(value)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(canonical(r[i]) for i in order) for r in rows)


def difference(df, con, sql: str) -> str:
    """Empty if both are equal."""
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    want, got = rows_of(names, cursor.fetchall()), rows_of(df.columns, df.collect())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(names)} and {sorted(df.columns)}"
    if len(want) != len(got):
        return f"{len(got)} rows, SQL has {len(want)}; first only in Spark {next((r for r in got if r not in set(want)), None)}; only in SQL {next((r for r in want if r not in set(got)), None)}"
    return next((f"{a} and in SQL {b}" for a, b in zip(got, want, strict=True) if a != b), "")
