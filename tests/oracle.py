"""Runs SQL by DuckDB over the tables of a folder, for comparison."""

from __future__ import annotations

import datetime
import glob
import math
import os

import duckdb


def plain(v):
    """A value in a form in which both engines agree."""
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def rows_of_spark(df) -> tuple[list[str], list[tuple]]:
    names = sorted(df.columns)
    return names, sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)


def rows_of_sql(sql: str, folder: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    result = con.sql(sql)
    names = sorted(result.columns)
    at = [result.columns.index(c) for c in names]
    return names, sorted((tuple(plain(r[i]) for i in at) for r in result.fetchall()), key=repr)
