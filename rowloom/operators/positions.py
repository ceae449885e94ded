"""Positions in an event log: offsets per partition, ranges and tails."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.errors import ToolkitError
from rowloom.functions.columns import require
from rowloom.operators.numbering import first_per_group


def offset_summary(df: DataFrame, commits: DataFrame | None = None) -> DataFrame:
    """Per partition: ``low`` mark, ``high`` mark (next offset), ``records`` and ``gaps`` between them.

    ``commits`` (partition, committed) adds the committed offset of a reader and its ``lag``;
    a reader without a commit lags by all records.
    """
    require(df, ["partition", "offset"])
    summary = df.groupBy("partition").agg(
        F.min("offset").alias("low"), (F.max("offset") + 1).alias("high"), F.count("offset").alias("records")
    )
    summary = summary.withColumn("gaps", F.col("high") - F.col("low") - F.col("records"))
    if commits is None:
        return summary
    require(commits, ["partition", "committed"])
    joined = summary.join(commits.select("partition", "committed"), "partition", "left")
    start = F.greatest(F.coalesce(F.col("committed"), F.col("low")), F.col("low"))
    return joined.withColumn("lag", F.greatest(F.col("high") - start, F.lit(0)))


def read_range(
    df: DataFrame, partition: int | None = None, from_offset: int | None = None, max_records: int | None = None
) -> DataFrame:
    """Records from an offset on, of one partition or all; with ``max_records`` the first ones by (partition, offset)."""
    require(df, ["partition", "offset"])
    if partition is not None:
        df = df.filter(F.col("partition") == partition)
    if from_offset is not None:
        df = df.filter(F.col("offset") >= from_offset)
    if max_records is None:
        return df
    return df.orderBy("partition", "offset").limit(max_records)


def read_tail(df: DataFrame, n: int, partition: int | None = None, partitions: int | None = None) -> DataFrame:
    """The last records of a log: ``max(1, n // partitions)`` of each partition, ``n`` in all.

    ``partitions`` is the number of partitions; without it one small job counts them. Every task
    keeps only its own last records per partition before the shuffle.
    """
    if n < 1:
        raise ToolkitError("n must be positive")
    require(df, ["partition", "offset"])
    if partition is not None:
        df = df.filter(F.col("partition") == partition)
        partitions = 1
    elif partitions is None:
        partitions = df.agg(F.count_distinct("partition").alias("n")).first()["n"]
    quota = max(1, n // max(partitions, 1))
    last = first_per_group(df, [F.col("partition")], [F.col("offset").desc()], quota, "__rank").drop("__rank")
    return last.orderBy("partition", F.col("offset").desc()).limit(n)
