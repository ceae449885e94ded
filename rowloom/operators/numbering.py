"""Ranks and row numbers within groups that may be too large for one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowloom.functions.columns import col, require
from rowloom.session import materialize


def number_within(
    df: DataFrame, keys: Sequence[str], order_by: Sequence[str], position: str = "position", total: str = "total"
) -> DataFrame:
    """Adds the 1-based position within a group, and the group's size, without a window over its rows.

    The table is range-partitioned and sorted by (keys, order), which splits a large group over
    many tasks, and written once to the shared folder with the running number inside each range.
    A group's positions then follow from its first number in a range plus its rows in earlier
    ranges. Only these counts, one per group and range, pass through a window.

    Rows that tie on the order go by a hash of the row, so a task that runs again places them alike;
    only equal rows keep the order in which they were read. That also splits a group of equal rows,
    which no range of its values could.
    """
    names, order = require(df, list(keys)), require(df, list(order_by))
    hashed = [col(f.name) for f in df.schema.fields if not any(t in f.dataType.simpleString() for t in ("map<", "variant"))]
    sort = [*[col(c).asc_nulls_first() for c in (*names, *order)], F.xxhash64(*hashed), F.col("__row")]
    placed = df.withColumn("__row", F.monotonically_increasing_id()).repartitionByRange(*sort).sortWithinPartitions(*sort)
    # high bits: number of the range; low 33 bits: row number inside it
    placed = materialize(placed.drop("__row").withColumn("__at", F.monotonically_increasing_id()), "numbered")
    placed = placed.withColumn("__range", F.shiftright("__at", 33))

    groups = [col(n) for n in names]
    counts = placed.groupBy("__range", *groups).agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    whole = Window.partitionBy(*groups)
    before = F.sum("__n").over(whole.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.withColumns({"__before": F.coalesce(before, F.lit(0)), total: F.sum("__n").over(whole)})

    right = counts.select(
        F.col("__range").alias("__r"), *[col(n).alias(f"__k{i}") for i, n in enumerate(names)], "__first", "__before", total
    )
    same = F.col("__range") == F.col("__r")
    for i, name in enumerate(names):
        same = same & col(name).eqNullSafe(F.col(f"__k{i}"))
    return placed.join(right, same).select(
        *[col(c) for c in df.columns],
        (F.col("__at") - F.col("__first") + F.col("__before") + 1).alias(position),
        col(total),
    )


def first_per_group(df: DataFrame, keys: Sequence[Column], order: Sequence[Column], n: int, rank: str = "__rank") -> DataFrame:
    """The first ``n`` rows of every group in a total order, with their rank.

    Spark drops the other rows before the shuffle, in the tasks that read them, while ``n`` is
    within its limit for that. Beyond it, a group is first cut down in parts, by the task a row
    comes from; the first n rows of all parts hold the first n of the group, however it is split.
    """
    limit = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold"))
    if n > limit:
        df = df.withColumn("__part", F.spark_partition_id())
        inner = Window.partitionBy(*keys, "__part").orderBy(*order)
        df = df.withColumn(rank, F.row_number().over(inner)).filter(F.col(rank) <= n).drop(rank, "__part")
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= n)
