"""Compare a Spark result with DuckDB's result of the oracle SQL, as multisets of rows."""

from __future__ import annotations

import datetime as dt
import decimal
import math
from collections import Counter

import duckdb
from pyspark.sql import DataFrame

from assetlake.tables import TABLES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def _plain(value: object) -> object:
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, (bytearray, bytes)):
        return bytes(value)
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, decimal.Decimal):
        return str(value)
    return value


def rows_of(df: DataFrame) -> Counter:
    names = sorted(df.columns)
    arrow = df.select(*[f"`{c}`" for c in names]).toArrow()
    return Counter(tuple(_plain(v) for v in row) for row in zip(*[arrow.column(c).to_pylist() for c in names]))


def expected_rows(con: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], Counter]:
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), Counter(tuple(_plain(row[i]) for i in order) for row in result.fetchall())


def type_names(df: DataFrame) -> dict[str, str]:
    return {f.name: str(f.type) for f in df.limit(0).toArrow().schema}


def expected_types(con: duckdb.DuckDBPyConnection, sql: str) -> dict[str, str]:
    return {f.name: str(f.type) for f in con.execute(sql).to_arrow_table().schema}
