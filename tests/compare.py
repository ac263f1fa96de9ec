"""Spark rows against DuckDB rows, without order."""

from __future__ import annotations

import datetime
import decimal
import os

import duckdb
from pyspark.sql import Row

SMALL = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, Row):
        return {k: plain(x) for k, x in v.asDict().items()}
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v


def shown(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if v != v else f"{float(v) + 0.0:.6g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(shown, v)) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{shown(x)}" for k, x in sorted(v.items())) + "}"
    return v.replace(tzinfo=None).isoformat() if isinstance(v, datetime.datetime) else str(v)


def connect(base: str = SMALL) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(base):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{base}/{name}'")
    return con


def assert_same(df, con, sql: str) -> None:
    cols = sorted(df.columns)
    spark_rows = sorted(tuple(shown(plain(r[c])) for c in cols) for r in df.collect())
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    assert sorted(names) == cols
    duck_rows = sorted(tuple(shown(r[names.index(c)]) for c in cols) for r in got.fetchall())
    assert spark_rows == duck_rows
