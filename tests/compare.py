"""Side by side: a query's rows and its SQL's rows from DuckDB."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os

import duckdb

SMALL = "/root/testdata/sf0.001"


def connection(sf_dir: str = SMALL) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    """Values of either engine in one form; numbers to nine digits."""
    if value is None or isinstance(value, (bool, str)):
        return value
    if isinstance(value, (int, float, decimal.Decimal)):
        value = float(value)
        return None if math.isnan(value) else float(f"{value:.9g}") + 0.0
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, datetime.date):
        return value.isoformat()
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return str(value)


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    made = [tuple(plain(row[k]) for k in order) for row in rows]
    return sorted(made, key=repr)


def assert_same(df, sql: str, sf_dir: str = SMALL) -> int:
    found = connection(sf_dir).sql(sql)
    assert sorted(df.columns) == sorted(found.columns)
    mine, theirs = sorted_rows(df.columns, df.collect()), sorted_rows(found.columns, found.fetchall())
    assert len(mine) == len(theirs)
    for a, b in zip(mine, theirs, strict=True):
        for x, y in zip(a, b, strict=True):
            close = isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-7, abs_tol=1e-9)
            assert x == y or close, (a, b)
    return len(mine)
