"""Rows of a query beside rows of its SQL, in an order and a form that both engines share."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os

import duckdb


def plain(x):
    if isinstance(x, bool | str | bytes | None):
        return x
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.10g}")
    if isinstance(x, decimal.Decimal):
        return float(f"{float(x):.10g}")
    if isinstance(x, int):
        return float(f"{x:.10g}") if abs(x) < 2**53 else x
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, list | tuple):
        return tuple(plain(y) for y in (x.values() if isinstance(x, dict) else x))
    if isinstance(x, dict):
        return tuple(plain(y) for y in x.values())
    return str(x)


def rows_of(df) -> tuple[list[str], list[tuple]]:
    names = sorted(df.columns)
    return names, sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)


def oracle(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    rows = found.fetchall()
    return sorted(names), sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


def same(df, sql: str, sf_dir: str) -> None:
    names, rows = rows_of(df)
    want_names, want = oracle(sql, sf_dir)
    assert names == want_names
    assert len(rows) == len(want)
    wrong = [(a, b) for a, b in zip(rows, want, strict=True) if a != b]
    assert not wrong, f"{len(wrong)} of {len(rows)} rows differ, first {wrong[0]}"
