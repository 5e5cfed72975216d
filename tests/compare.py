"""Run a registered query on Spark and its check SQL on DuckDB, and compare the rows."""

from __future__ import annotations

import math
from collections import Counter

import duckdb
from pyspark.sql import DataFrame

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(
            f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')"
        )
    return connection


def plain(value: object) -> object:
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    if isinstance(value, float) and value == 0:
        return 0.0
    return value


def _bag(columns: list[str], rows: list) -> tuple[list[str], Counter]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    bag = Counter(tuple(plain(row[i]) for i in order) for row in rows)
    return [columns[i] for i in order], bag


def differences(spark_df: DataFrame, connection: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty text if columns and rows agree, otherwise what differs."""
    result = connection.execute(sql)
    want_columns, want = _bag([d[0] for d in result.description], result.fetchall())
    got_columns, got = _bag(spark_df.columns, spark_df.collect())
    if got_columns != want_columns:
        return f"columns: spark {got_columns}, sql {want_columns}"
    if got == want:
        return ""
    only_spark, only_sql = got - want, want - got
    return (
        f"rows: spark {sum(got.values())}, sql {sum(want.values())}; "
        f"only spark {list(only_spark.items())[:2]}; only sql {list(only_sql.items())[:2]}"
    )
