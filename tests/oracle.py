"""Compare a Spark result with DuckDB's on the same Parquet tables."""

from __future__ import annotations

import math
from collections import Counter
from decimal import Decimal

import duckdb

from rowloom.plans.catalog import TABLES


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    if isinstance(value, Decimal):
        return ("decimal", str(value))
    if isinstance(value, bytearray):
        return bytes(value)
    return value


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in rows)


def differences(spark, folder, entry, connection) -> list[str]:
    """Texts that say how the two results differ; empty when they agree."""
    df = entry.run(spark, folder)
    spark_columns, spark_rows = canonical(df.columns, [tuple(r) for r in df.collect()])
    cursor = connection.execute(entry.sql)
    sql_columns, sql_rows = canonical([d[0] for d in cursor.description], cursor.fetchall())
    problems = []
    if spark_columns != sql_columns:
        problems.append(f"columns {spark_columns} != {sql_columns}")
    elif spark_rows != sql_rows:
        only_spark, only_sql = spark_rows - sql_rows, sql_rows - spark_rows
        problems.append(f"rows {sum(spark_rows.values())} / {sum(sql_rows.values())} in {spark_columns}")
        problems.append(f"only Spark ({sum(only_spark.values())}): {list(only_spark)[:3]}")
        problems.append(f"only SQL ({sum(only_sql.values())}): {list(only_sql)[:3]}")
    if not spark_rows:
        problems.append("no rows")
    return problems
