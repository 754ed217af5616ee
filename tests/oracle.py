"""Holds a query's rows against its SQL in DuckDB."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def canon(v):
    if isinstance(v, bool) or v is None:
        return repr(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, int):
        return f"{float(v):.9g}" if abs(v) < 2**53 else str(v)
    return str(v)


def compare(spark, name: str, query, sql: str, folder: str) -> None:
    df = query(spark, folder)
    names = sorted(df.columns)
    con = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    cur = con.execute(f"select {', '.join(chr(34) + n + chr(34) for n in names)} from ({sql})")
    there = sorted(tuple(canon(v) for v in r) for r in cur.fetchall())
    assert sorted(d[0] for d in con.execute(f"select * from ({sql}) limit 0").description) == names
    here = sorted(tuple(canon(r[n]) for n in names) for r in df.collect())
    assert len(here) == len(there), f"{name}: {len(here)} rows, the SQL has {len(there)}"
    for a, b in zip(here, there, strict=True):
        assert a == b, f"{name}: {[(n, x, y) for n, x, y in zip(names, a, b, strict=True) if x != y]}"
