"""Compare a query with its SQL, whatever the order of rows."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else f"{value:.6g}"
    if isinstance(value, (list, tuple)):
        return tuple(map(_plain, value))
    return None if value is None else str(value)


def rows_of_frame(frame) -> list:
    names = sorted(frame.columns)
    return sorted((tuple(_plain(r[n]) for n in names) for r in frame.collect()), key=str)


def rows_of_sql(con, sql: str, names: list[str]) -> list:
    result = con.execute(sql)
    order = [[d[0] for d in result.description].index(n) for n in sorted(names)]
    return sorted((tuple(_plain(row[k]) for k in order) for row in result.fetchall()), key=str)
