"""Databases and catalog tables: JDBC reads, introspection, CTAS, partitions."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from datetime import date, datetime
from decimal import Decimal
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from rowloom.errors import ToolkitError
from rowloom.operators.sql import read_only

# Fixed names of table formats.
TABLE_FORMATS = {"PARQUET": "parquet", "ORC": "orc", "JSON": "json", "TEXTFILE": "text", "CSV": "csv"}
# How table formats write a null partition value.
NULL_PARTITION = "__HIVE_DEFAULT_PARTITION__"


def sql_literal(value: Any) -> str:
    """A value as standard SQL."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, (int, float, Decimal)):
        return str(value)
    if isinstance(value, datetime):
        return f"TIMESTAMP '{value.isoformat(sep=' ')}'"
    if isinstance(value, date):
        return f"DATE '{value.isoformat()}'"
    if isinstance(value, str):
        if "\\" in value:  # some databases read it as an escape, others as itself
            raise ToolkitError("text parameters must not hold a backslash")
        return "'" + value.replace("'", "''") + "'"
    raise ToolkitError(f"cannot pass a value of type {type(value).__name__}")


def bind_parameters(sql: str, params: Sequence[Any]) -> str:
    """Fill ``?`` placeholders outside quotes and comments with literals."""
    pieces = re.split(r"('(?:[^']|'')*'|\"[^\"]*\"|--[^\n]*|/\*(?s:.*?)\*/)", sql)
    values = iter(params)
    missing = object()

    def fill(_: re.Match) -> str:
        value = next(values, missing)
        if value is missing:
            raise ToolkitError("more placeholders than parameters")
        return sql_literal(value)

    pieces[::2] = [re.sub(r"\?", fill, p) for p in pieces[::2]]
    if next(values, missing) is not missing:
        raise ToolkitError("more parameters than placeholders")
    return "".join(pieces)


def jdbc_options(
    url: str,
    query: str,
    params: Sequence[Any] = (),
    partition_column: str | None = None,
    bounds: tuple[Any, Any] | None = None,
    num_partitions: int | None = None,
    fetch_size: int = 10_000,
    properties: Mapping[str, str] | None = None,
) -> dict[str, str]:
    """Options of a read-only JDBC scan, in parallel ranges if a partition column is given."""
    text = bind_parameters(read_only(query), params)
    options = {"url": url, "fetchsize": str(fetch_size), **dict(properties or {})}
    split = (partition_column, bounds, num_partitions)
    if all(s is None for s in split):
        return {**options, "query": text}
    if any(s is None for s in split):
        raise ToolkitError("partition_column, bounds and num_partitions belong together")
    return {
        **options,
        "dbtable": f"({text}) q",
        "partitionColumn": partition_column,
        "lowerBound": str(bounds[0]),
        "upperBound": str(bounds[1]),
        "numPartitions": str(num_partitions),
    }


def jdbc_read(spark: SparkSession, url: str, query: str, max_rows: int | None = None, **options: Any) -> DataFrame:
    """Run one read-only query in a database and read its result; see :func:`jdbc_options`.

    Without a partition column one task reads everything, so large results need one. Filters and
    limits put on the DataFrame are pushed into the database by Spark.
    """
    df = spark.read.format("jdbc").options(**jdbc_options(url, query, **options)).load()
    return df if max_rows is None else df.limit(max_rows)


def _like(pattern: str | None):
    """A test for SQL LIKE, without regard to case."""
    if pattern is None:
        return lambda name: True
    signs = {"%": ".*", "_": "."}
    regex = re.compile("".join(signs.get(c, re.escape(c)) for c in pattern), re.IGNORECASE | re.DOTALL)
    return lambda name: regex.fullmatch(name) is not None


def introspect_catalog(
    spark: SparkSession, schema_like: str | None = None, table_like: str | None = None, max_tables: int | None = None
) -> DataFrame:
    """(table_schema, table_name, position, column_name, type, nullable) of the session's catalog.

    A JDBC database shows up here once it is configured as a catalog and made current. Only
    metadata is read, of all tables, or of the first ``max_tables`` in name order.
    """
    rows: list[tuple] = []
    tables = 0
    for schema in sorted(d.name for d in spark.catalog.listDatabases() if _like(schema_like)(d.name)):
        names = sorted(t.name for t in spark.catalog.listTables(schema) if not t.isTemporary and _like(table_like)(t.name))
        for table in names:
            if tables == max_tables:
                break
            tables += 1
            columns = spark.catalog.listColumns(f"`{schema}`.`{table}`")
            rows += [(schema, table, i, c.name, c.dataType, c.nullable) for i, c in enumerate(columns)]
    return spark.createDataFrame(
        rows, "table_schema string, table_name string, position int, column_name string, type string, nullable boolean"
    )


def ctas_export(
    spark: SparkSession,
    select_sql: str,
    table: str,
    fmt: str = "PARQUET",
    location: str | None = None,
    partition_by: str | Sequence[str] | None = None,
) -> DataFrame:
    """Create a table from a read-only query and return it; an existing table is an error."""
    if fmt.upper() not in TABLE_FORMATS:
        raise ToolkitError(f"unknown table format {fmt!r}; known: {list(TABLE_FORMATS)}")
    text = read_only(select_sql)
    if text.upper().startswith("EXPLAIN"):
        raise ToolkitError("a plan cannot be stored as a table")
    writer = spark.sql(text).write.format(TABLE_FORMATS[fmt.upper()])
    if location is not None:
        writer = writer.option("path", location)
    if partition_by is not None:
        writer = writer.partitionBy(partition_by)
    writer.saveAsTable(table)
    return spark.table(table)


def list_partitions(spark: SparkSession, table: str, max_partitions: int | None = None) -> DataFrame:
    """(partition, values, location, parameters) of a partitioned table, metadata only.

    One call to the catalog lists all partitions with their places. Values are unescaped; a null value is null.
    """
    parsed = spark._jsparkSession.sessionState().sqlParser().parseTableIdentifier(table)
    catalog = spark._jsparkSession.sessionState().catalog()
    described = catalog.getTableMetadata(parsed)
    names = [described.partitionColumnNames().apply(i) for i in range(described.partitionColumnNames().size())]
    found = catalog.listPartitions(parsed, spark._jvm.scala.Option.empty())
    rows = []
    for i in range(found.size()):
        part = found.apply(i)
        raw = [part.spec().apply(n) for n in names]
        # the shown name escapes what a path must not hold, as the folder's name does
        escape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        spec = "/".join(f"{escape(n)}={NULL_PARTITION if v is None else escape(v)}" for n, v in zip(names, raw, strict=True))
        values = [None if v == NULL_PARTITION else v for v in raw]
        parameters = ", ".join(sorted(f"{t._1()}={t._2()}" for t in map(part.parameters().toSeq().apply, range(part.parameters().size()))))
        rows.append((spec, values, part.location().toString(), f"{{{parameters}}}" if parameters else None))
    rows.sort()
    rows = rows if max_partitions is None else rows[:max_partitions]
    return spark.createDataFrame(rows, "partition string, values array<string>, location string, parameters string")


def repair_partitions(spark: SparkSession, table: str) -> DataFrame:
    """Register partition folders added by hand; returns the partitions now known."""
    spark.sql(f"MSCK REPAIR TABLE {table}")
    return spark.sql(f"SHOW PARTITIONS {table}")
