"""Compare a Spark result with DuckDB SQL on the same Parquet tables."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(out, key=lambda r: tuple((v is None, str(v)) for v in r))


def differences(df, con, sql):
    """Empty text when equal, else a short account."""
    cursor = con.execute(sql)
    names, want = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    columns, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if columns != names:
        return f"columns {columns} != {names}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    for a, b in zip(got, want):
        if a != b:
            return f"{columns}: {a} != {b}"
    return ""
