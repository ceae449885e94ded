"""Data behind charts: bars, pivots, resampled series, histograms, scatter points."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.errors import ToolkitError
from rowloom.functions.columns import col, is_numeric, is_time, present, require, type_of
from rowloom.operators.aggregate import aggregate_column, value_counts
from rowloom.operators.select import PREVIEW_ROWS, sample_random

# Fixed values of the "auto" time step and of histograms.
HOURLY_UP_TO_DAYS = 3
BINS = 30
STEPS = {"second": "1 second", "minute": "1 minute", "hour": "1 hour", "day": "1 day", "week": "7 days"}


def count_bars(df: DataFrame, x: str, top_k: int | None = None) -> DataFrame:
    """(x, n): rows per value of x, largest first."""
    return value_counts(df, x, top_k).withColumnRenamed("value", x)


def bar_data(df: DataFrame, x: str, y: str, agg: str = "mean", top_k: int | None = None) -> DataFrame:
    """(x, y): y aggregated by x, or y itself where every row has its own x; the top_k largest."""
    require(df, [x, y])
    grouped = df.groupBy(present(df, x).alias("__x")).agg(
        aggregate_column(df, y, agg).alias("__agg"),
        F.count(F.lit(1)).alias("__rows"),
        F.max(present(df, y)).alias("__own"),
    )
    value = F.col("__agg")
    if is_numeric(type_of(df, y)):  # only a number can stand for itself
        single = grouped.agg(((F.max("__rows") == 1) & (F.count(F.lit(1)) == F.count("__x"))).alias("s")).scalar()
        value = F.when(single, F.col("__own")).otherwise(value)
    bars = grouped.filter(F.col("__x").isNotNull()).select(F.col("__x").alias(x), value.alias(y))
    if top_k is None:
        return bars
    return bars.filter(col(y).isNotNull()).orderBy(col(y).desc(), col(x)).limit(top_k)


def grouped_bars(df: DataFrame, x: str, series: str, y: str, agg: str = "mean") -> DataFrame:
    """(x, series, y): y aggregated per x and series; rows without either are left out."""
    require(df, [x, series, y])
    kept = df.filter(present(df, x).isNotNull() & present(df, series).isNotNull())
    return kept.groupBy(col(x), col(series)).agg(aggregate_column(df, y, agg).alias(y))


def pivot_data(
    df: DataFrame,
    x: str,
    series: str,
    y: str,
    agg: str = "mean",
    values: Sequence[Any] | None = None,
    max_series: int | None = None,
) -> DataFrame:
    """One row per x, one column per value of ``series``.

    Give ``values`` to save the pass that finds them. With ``max_series``, more values are an
    error: such a table may be too wide for a chart, and dropping series would falsify it.
    """
    require(df, [x, series, y])
    kept = df.filter(present(df, x).isNotNull() & present(df, series).isNotNull())
    if values is None:
        distinct = kept.select(col(series).alias("s")).distinct()
        found = (distinct if max_series is None else distinct.limit(max_series + 1)).collect()
        if max_series is not None and len(found) > max_series:
            raise ToolkitError(f"{series!r} has more than {max_series} values; choose another series column")
        values = sorted(r["s"] for r in found)
    return kept.groupBy(col(x)).pivot(series, list(values)).agg(aggregate_column(df, y, agg))


def _coarse(every: str) -> str:
    """Steps shorter than a day are laid out day by day."""
    return STEPS["day"] if every in ("second", "minute", "hour") else STEPS[every]


def _axis_ends(every: str, kind: T.DataType) -> tuple[Column, Column]:
    if every in ("second", "minute", "hour"):
        return F.date_trunc("day", "a").cast(kind), F.col("b")
    return F.col("a"), F.col("b")


def resample(df: DataFrame, ts: str, value: str, every: str = "auto") -> DataFrame:
    """Mean of ``value`` per time bucket, empty buckets included with a null mean.

    ``every`` is second, minute, hour, day or week, ``raw`` for the points as they are, or
    ``auto``: hourly over a span of up to 3 days, else daily, however many rows there are.
    """
    require(df, [ts, value])
    if not is_time(type_of(df, ts)):
        raise ToolkitError(f"column {ts!r} is not a time")
    measured = present(df, value)
    if isinstance(type_of(df, value), T.BooleanType):
        measured = measured.cast("int")
    points = df.select(col(ts).alias(ts), measured.alias(value)).filter(col(ts).isNotNull())
    if every == "auto":
        ends = points.agg(F.min(col(ts)).alias("a"), F.max(col(ts)).alias("b")).first()
        span = (ends["b"] - ends["a"]).total_seconds() if ends["a"] is not None and hasattr(ends["b"], "hour") else None
        every = "hour" if span is not None and span <= HOURLY_UP_TO_DAYS * 86400 else "day"
    if every == "raw":
        return points
    if every not in STEPS:
        raise ToolkitError(f"unknown step {every!r}; known: {[*STEPS, 'raw', 'auto']}")
    bucket = F.date_trunc(every, col(ts)).cast(type_of(df, ts))
    means = points.groupBy(bucket.alias(ts)).agg(F.avg(col(value)).alias(value))
    # the time axis depends on the time span, not on the rows
    axis = means.agg(F.min(col(ts)).alias("a"), F.max(col(ts)).alias("b")).select(
        "a", "b", F.explode(F.sequence(*_axis_ends(every, type_of(df, ts)), F.expr(f"INTERVAL {_coarse(every)}"))).alias("d")
    )
    if _coarse(every) != STEPS[every]:  # days first, spread over tasks, then the steps of each day
        last = F.col("d") + F.expr(f"INTERVAL 1 DAY - INTERVAL {STEPS[every]}")
        axis = axis.repartition("d").select("a", "b", F.explode(F.sequence("d", last, F.expr(f"INTERVAL {STEPS[every]}"))).alias("d"))
        axis = axis.filter(F.col("d").between(F.col("a"), F.col("b")))
    axis = axis.select(F.col("d").cast(type_of(df, ts)).alias(ts))
    return axis.join(means, ts, "left")


def histogram(df: DataFrame, column: str, bins: int = BINS) -> DataFrame:
    """(bin, low, high, n): equal-width bins over the finite min..max; the last one includes its upper end.

    Empty bins are listed. A column with one value puts all rows into one bin of width 1 / bins
    around it, as its range is widened by 0.5 on both sides.
    """
    if bins < 1:
        raise ToolkitError("bins must be positive")
    if not (is_numeric(type_of(df, column)) or isinstance(type_of(df, column), T.BooleanType)):
        raise ToolkitError(f"column {column!r} is not numeric")
    v = present(df, column).cast("double")
    v = F.when(F.abs(v) < F.lit(float("inf")), v)
    flat = F.col("a") == F.col("b")
    span = df.agg(F.min(v).alias("a"), F.max(v).alias("b")).select(
        F.struct(
            F.when(flat, F.col("a") - 0.5).otherwise(F.col("a")).alias("a"),
            F.when(flat, F.col("b") + 0.5).otherwise(F.col("b")).alias("b"),
        ).alias("span")
    ).scalar()  # one subquery, run once for all its uses
    width = (span["b"] - span["a"]) / F.lit(bins)
    place = F.least(F.floor((v - span["a"]) / width), F.lit(bins - 1)).cast("int")
    counted = df.filter(v.isNotNull()).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    axis = (
        df.sparkSession.range(1)
        .select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), span["a"].alias("a"), span["b"].alias("b"))
        .filter(F.col("a").isNotNull())
    )
    step = (F.col("b") - F.col("a")) / F.lit(bins)
    return axis.join(counted, "bin", "left").select(
        "bin",
        (F.col("a") + F.col("bin") * step).alias("low"),
        F.when(F.col("bin") == bins - 1, F.col("b")).otherwise(F.col("a") + (F.col("bin") + 1) * step).alias("high"),
        F.coalesce(F.col("n"), F.lit(0)).alias("n"),
    )


def scatter_data(
    df: DataFrame, x: str, y: str, n: int = PREVIEW_ROWS, key: str | Sequence[str] | None = None, seed: int = 0
) -> DataFrame:
    """A repeatable sample of n (x, y) points; ``key`` identifies rows, else the point itself does."""
    names = require(df, [x, y])
    keys = require(df, key) if key is not None else names
    narrow = df.select(*[col(c) for c in dict.fromkeys([*keys, *names])])
    return sample_random(narrow, n, keys, seed).select(*[col(c) for c in dict.fromkeys(names)])
