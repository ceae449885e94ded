"""Event envelopes: the common shape of records of an event log."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.errors import ToolkitError
from rowloom.functions.columns import col, require, type_of

SCHEMA = T.StructType(
    [
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
        T.StructField("timestamp", T.LongType()),
        T.StructField("key", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("headers", T.MapType(T.StringType(), T.StringType())),
    ]
)


def _text(df: DataFrame, name: str) -> Column:
    """Text of a column; bytes as UTF-8 with the replacement character for bad ones."""
    if isinstance(type_of(df, name), T.BinaryType):
        return F.make_valid_utf8(col(name).cast("string"))
    return col(name).cast("string")


def _headers(df: DataFrame) -> Column:
    """Headers as a map: from a map, JSON text, or the log connector's array of (key, value)."""
    dtype = type_of(df, "headers")
    text = T.MapType(T.StringType(), T.StringType())
    if isinstance(dtype, T.MapType):
        return F.coalesce(col("headers").cast(text), F.create_map().cast(text))
    if isinstance(dtype, T.StringType):
        return F.coalesce(F.from_json(col("headers"), text), F.create_map().cast(text))
    if isinstance(dtype, T.ArrayType):
        # a repeated header keeps its last value
        entries = F.filter(
            F.transform(
                col("headers"),
                lambda h, i: F.struct(h["key"].alias("k"), F.make_valid_utf8(h["value"].cast("string")).alias("v"), i.alias("i")),
            ),
            lambda e: ~F.exists(F.slice(col("headers"), e["i"] + 2, F.size(col("headers"))), lambda h: h["key"] == e["k"]),
        )
        pairs = F.transform(entries, lambda e: F.struct(e["k"].alias("key"), e["v"].alias("value")))
        return F.coalesce(F.map_from_entries(pairs), F.create_map().cast(text))
    raise ToolkitError(f"headers of type {dtype.simpleString()} are not supported")


def _millis(df: DataFrame, name: str) -> Column:
    dtype = type_of(df, name)
    if isinstance(dtype, T.TimestampNTZType):
        return F.unix_millis(col(name).cast("timestamp"))
    if isinstance(dtype, T.TimestampType):
        return F.unix_millis(col(name))
    return col(name).cast("bigint")


def to_envelope(df: DataFrame, decode_value: bool = True) -> DataFrame:
    """Any batch or streaming table with the envelope columns, in the envelope types.

    With ``decode_value=False`` a binary value stays binary, for payload triage.
    """
    require(df, ["partition", "offset", "timestamp", "key", "value"])
    empty = F.create_map().cast(SCHEMA["headers"].dataType)
    return df.select(
        col("partition").cast("int").alias("partition"),
        col("offset").cast("bigint").alias("offset"),
        _millis(df, "timestamp").alias("timestamp"),
        _text(df, "key").alias("key"),
        (_text(df, "value") if decode_value else col("value")).alias("value"),
        (_headers(df) if "headers" in df.columns else empty).alias("headers"),
    )


def read_envelope(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | str | None = None) -> DataFrame:
    """Envelopes kept in files, as a batch table."""
    from rowloom.sources.files import read_source

    return to_envelope(read_source(spark, path, fmt, schema))


def read_log(spark: SparkSession, servers: str, topic: str, options: Mapping[str, str] | None = None, stream: bool = False) -> DataFrame:
    """Envelopes of a Kafka topic; needs Spark's Kafka connector on the classpath."""
    source = spark.readStream if stream else spark.read
    reader = source.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    reader = reader.option("includeHeaders", "true").options(**dict(options or {}))
    return to_envelope(reader.load())
