"""Running a query and its oracle on the same tables and comparing them as the driver does: columns by name, rows in any order."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def oracle(sql: str, folder: str):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        path = Path(folder, f"{t}.parquet")
        if path.exists():
            con.execute(f"create view {t} as select * from '{path}{'/*.parquet' if path.is_dir() else ''}'")
    got = con.execute(sql)
    return [c[0] for c in got.description], got.fetchall()


def difference(df, sql: str, folder: str) -> str:
    columns, want = oracle(sql, folder)
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} and {sorted(columns)}"
    a, b = rows_of(df.columns, [tuple(r) for r in df.collect()]), rows_of(columns, want)
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows"
    return next((f"{x} and {y}" for x, y in zip(a, b, strict=True) if x != y), "")
