"""Comparing a Spark result with the result of SQL in DuckDB, row by row."""

from __future__ import annotations

import math
from collections import Counter

import duckdb
from pyspark.sql import DataFrame

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _type_family(name: str) -> str:
    name = name.lower()
    if name.startswith("decimal"):
        return "decimal"
    return {
        "varchar": "string", "string": "string", "bigint": "bigint", "int": "int",
        "integer": "int", "double": "double", "boolean": "boolean", "date": "date",
        "timestamp": "timestamp", "timestamp_ntz": "timestamp",
    }.get(name, name)


def _value(v):
    if isinstance(v, float) and math.isnan(v):
        return "NaN"
    return v


def differences(actual: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """What differs between the two, or None."""
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    expected_rows = cursor.fetchall()
    described = con.execute(f"DESCRIBE {sql}").fetchall()
    expected_types = {r[0]: _type_family(r[1]) for r in described}
    actual_types = {f.name: _type_family(f.dataType.simpleString()) for f in actual.schema.fields}
    if actual_types != expected_types:
        return f"schema: {actual_types} expected {expected_types}"
    columns = sorted(names)
    at = [names.index(c) for c in columns]
    expected = Counter(tuple(_value(r[i]) for i in at) for r in expected_rows)
    got = Counter(
        tuple(_value(v) for v in r)
        for r in actual.select(*[f"`{c}`" for c in columns]).collect()
    )
    if got != expected:
        extra, missing = got - expected, expected - got
        return (
            f"{sum(got.values())} rows, expected {sum(expected.values())}; {columns}\n"
            f"extra {sum(extra.values())}: {list(extra)[:3]}\n"
            f"missing {sum(missing.values())}: {list(missing)[:3]}"
        )
    if not expected:
        return "no rows at all"
    return None
