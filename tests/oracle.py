"""Compares queries with their SQL on the same tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connect(folder: str):
    con = duckdb.connect()
    for f in sorted(Path(folder).glob("*.parquet")):
        source = f"{f}/*.parquet" if f.is_dir() else str(f)
        con.execute(f"create view {f.stem} as select * from read_parquet('{source}')")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if hasattr(v, "asDict"):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    return v if isinstance(v, (int, str)) else str(v)


def differences(spark, con, folder: str, query, sql: str) -> str | None:
    """None if rows and columns agree; else what differs."""
    df = query(spark, folder)
    cols = sorted(df.columns)
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    theirs = cur.fetchall()
    if sorted(names) != cols:
        return f"columns {cols} and {sorted(names)}"
    at = [names.index(c) for c in cols]
    a = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    b = sorted((tuple(plain(r[i]) for i in at) for r in theirs), key=repr)
    if a != b:
        only_a, only_b = [x for x in a if x not in set(b)][:3], [x for x in b if x not in set(a)][:3]
        return f"{len(a)} and {len(b)} rows, e.g. {only_a} and {only_b} ({cols})"
    return None
