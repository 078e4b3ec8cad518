"""Compare rows of a Spark query with those of its SQL in DuckDB."""

from __future__ import annotations

import datetime
import decimal
import math
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame


def plain(value: object) -> object:
    """A value in a form in which both engines' agree."""
    if value is None or isinstance(value, (bool, str)):
        return value
    if isinstance(value, decimal.Decimal):
        return plain(float(value))
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, int):
        return float(value) if abs(value) < 1 << 53 else value
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.replace(tzinfo=None).isoformat() if isinstance(value, datetime.datetime) else value.isoformat()
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    if hasattr(value, "asDict"):
        return plain(value.asDict())
    if isinstance(value, dict):
        return tuple(sorted((str(k), plain(v)) for k, v in value.items()))
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return str(value)


def rows(names: list[str], values: list) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(row[i]) for i in order) for row in values), key=repr)


def tables(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def assert_same(found: DataFrame, sql: str, con: duckdb.DuckDBPyConnection) -> None:
    expected = con.execute(sql)
    names = [d[0] for d in expected.description]
    assert sorted(found.columns) == sorted(names)
    got, want = rows(found.columns, found.collect()), rows(names, expected.fetchall())
    assert len(got) == len(want)
    assert got == want
