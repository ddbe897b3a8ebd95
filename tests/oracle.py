"""Comparison of a query with its DuckDB statement: same columns, same rows whatever their order."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return int(v) if isinstance(v, bool) else v


def difference(spark, query, sql: str, folder: str) -> str:
    """Empty, or what differs."""
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{folder}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    want = con.sql(sql)
    got = query(spark, folder)
    columns = sorted(got.columns)
    if columns != sorted(want.columns):
        return f"columns {columns} against {sorted(want.columns)}"
    quoted = ", ".join(f'"{c}"' for c in columns)
    b = Counter(tuple(map(plain, r)) for r in want.select(quoted).fetchall())
    a = Counter(tuple(map(plain, r)) for r in got.select(*[f"`{c}`" for c in columns]).collect())
    if a == b:
        return ""
    return f"{sum(a.values())} rows against {sum(b.values())}; only ours {str(list((a - b).items())[:3])[:600]}; only theirs {str(list((b - a).items())[:3])[:600]}"
