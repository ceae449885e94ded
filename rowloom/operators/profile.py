"""Column profiles, chart suggestions, and evidence bundles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.errors import ToolkitError
from rowloom.functions.columns import col, is_numeric, is_time, require
from rowloom.operators import charts
from rowloom.operators.aggregate import describe, value_frequencies
from rowloom.operators.select import filter_rows, preview
from rowloom.sources.files import write_table

# Fixed values of the column classes.
ID_MIN_ROWS = 10
ID_MIN_SHARE = 0.95
ID_MAX_NULL_RATIO = 0.1
CATEGORY_LIMIT = 20
COUNT_LIKE_WORDS = ("count", "action", "total", "sum")
LONG_SERIES = 100


def profile_columns(df: DataFrame, columns: str | Sequence[str] | None = None) -> DataFrame:
    """Per column: ``dtype, rows, nulls, null_ratio, cardinality, max_repeat, class``.

    Everything follows from the value frequencies, so one shuffle serves all columns.
    """
    names = require(df, columns) if columns is not None else df.columns
    missing = ~F.col("present")
    totals = (
        value_frequencies(df, names)
        .groupBy("column")
        .agg(
            F.sum("n").alias("rows"),
            F.coalesce(F.sum(F.when(missing, F.col("n"))), F.lit(0)).alias("nulls"),
            F.count_if("present").alias("cardinality"),
            F.coalesce(F.max(F.when(~missing, F.col("n"))), F.lit(0)).alias("max_repeat"),
        )
    )
    fields = [df.schema[n] for n in names]

    def lookup(values: Sequence[Any]):
        return F.create_map(*[x for n, v in zip(names, values) for x in (F.lit(n), F.lit(v))])[F.col("column")]

    time = lookup([is_time(f.dataType) for f in fields])
    number = lookup([is_numeric(f.dataType) or isinstance(f.dataType, T.BooleanType) for f in fields])
    text = lookup([isinstance(f.dataType, (T.StringType, T.ArrayType, T.MapType, T.StructType)) for f in fields])
    ratio = F.when(F.col("rows") > 0, F.col("nulls") / F.col("rows")).otherwise(F.lit(0.0))
    looks_unique = (
        (F.col("rows") >= ID_MIN_ROWS)
        & (F.col("cardinality") > F.col("rows") * ID_MIN_SHARE)
        & (F.col("null_ratio") < ID_MAX_NULL_RATIO)
    )
    kind = (
        F.when(time, "datetime")
        .when(number, "numeric")
        .when(looks_unique, "id")
        .when((F.col("cardinality") < CATEGORY_LIMIT) | text, "categorical")
        .otherwise("other")
    )
    return totals.withColumns(
        {
            "dtype": lookup([f.dataType.simpleString() for f in fields]),
            "position": lookup(list(range(len(names)))),
            "null_ratio": ratio,
        }
    ).withColumn("class", kind)


@dataclass(frozen=True)
class ChartSpec:
    """What to draw. ``y`` is None for counts."""

    chart_type: str
    x: str | None = None
    y: str | None = None
    agg: str = "mean"
    group_by: str | None = None
    date_granularity: str | None = None
    top_k: int | None = None
    filters: list[Mapping[str, Any]] = field(default_factory=list)


def suggest_chart(
    profile: DataFrame, hints: Mapping[str, Any] | None = None, top_k: int | None = None, long_series: int = LONG_SERIES
) -> ChartSpec:
    """A chart for a profiled table; hints, if any, decide alone. ``top_k`` bars at most, if given.

    A line of more than ``long_series`` points is drawn by hour or day, a shorter one point by point.

    Reads the profile (one row per column) on the driver, never the table.
    """
    if hints:
        return ChartSpec(
            hints.get("chart_type") or "bar",
            hints.get("x"),
            hints.get("y"),
            hints.get("agg", "mean"),
            hints.get("group_by"),
            hints.get("date_granularity"),
            hints.get("top_k"),
            list(hints.get("filters") or []),
        )
    rows = sorted(profile.collect(), key=lambda r: r["position"])
    if not rows:
        raise ToolkitError("the profile has no columns")
    by_class: dict[str, list] = {}
    for row in rows:
        by_class.setdefault(row["class"], []).append(row)
    times, numbers, categories = (by_class.get(c, []) for c in ("datetime", "numeric", "categorical"))
    if times and numbers:
        granularity = "auto" if rows[0]["rows"] > long_series else None
        return ChartSpec("line", times[0]["column"], numbers[0]["column"], date_granularity=granularity)
    if categories and numbers:
        names = [n["column"] for n in numbers]
        preferred = [n for n in names if any(word in n.lower() for word in COUNT_LIKE_WORDS)]
        repeats = categories[0]["max_repeat"] > 1
        return ChartSpec(
            "bar",
            categories[0]["column"],
            (preferred or names)[0],
            group_by=categories[1]["column"] if len(categories) > 1 and repeats else None,
            top_k=top_k,
        )
    if len(numbers) > 1:
        return ChartSpec("scatter", numbers[0]["column"], numbers[1]["column"])
    if numbers:
        return ChartSpec("histogram", numbers[0]["column"])
    return ChartSpec("bar", (categories or rows)[0]["column"])


def chart_data(df: DataFrame, spec: ChartSpec, key: str | Sequence[str] | None = None) -> DataFrame:
    """The points of a suggested chart. ``key`` identifies rows for the sample of a scatter chart.

    Grouped bars come in long form (x, series, y), so any number of series fits;
    :func:`rowloom.operators.charts.pivot_data` gives a column per series on request.
    """
    if spec.x is None:
        raise ToolkitError("the chart has no x column")
    df = filter_rows(df, spec.filters)
    if spec.chart_type == "line":
        if spec.y is None:
            raise ToolkitError("a line chart needs a y column")
        return charts.resample(df, spec.x, spec.y, spec.date_granularity or "raw")
    if spec.chart_type == "bar":
        if spec.y is None:
            return charts.count_bars(df, spec.x, spec.top_k)
        if spec.group_by:
            return charts.grouped_bars(df, spec.x, spec.group_by, spec.y, spec.agg)
        return charts.bar_data(df, spec.x, spec.y, spec.agg, spec.top_k)
    if spec.chart_type == "scatter":
        return charts.scatter_data(df, spec.x, spec.y, key=key)
    if spec.chart_type == "histogram":
        return charts.histogram(df, spec.x)
    raise ToolkitError(f"unknown chart type {spec.chart_type!r}")


@dataclass(frozen=True)
class Evidence:
    """Where an evidence bundle was written."""

    path: str
    parquet: str
    csv: str
    metadata: str


def evidence_bundle(
    df: DataFrame, path: str, include_describe: bool = True, sample_rows: int = 50, approx: bool = False
) -> Evidence:
    """Write a table as Parquet and CSV with a JSON record of its shape, statistics and first rows.

    The input plan runs once, for the Parquet copy. Everything else reads that copy.
    """
    spark = df.sparkSession
    root = path.rstrip("/")
    result = Evidence(root, f"{root}/data.parquet", f"{root}/data.csv", f"{root}/metadata.json")
    df.write.parquet(result.parquet)
    saved = spark.read.schema(df.schema).parquet(result.parquet)
    write_table(saved, result.csv, "csv")

    names = F.array(*[F.lit(n) for n in df.columns])
    dtypes = F.array(*[F.lit(f.dataType.simpleString()) for f in df.schema.fields])
    record = saved.agg(F.count(F.lit(1)).alias("rows")).select("rows", names.alias("columns"), dtypes.alias("dtypes"))
    # both lists are short by construction: one entry per column, and at most sample_rows rows
    sample = preview(saved, sample_rows).agg(F.collect_list(F.struct(*[col(c) for c in df.columns])).alias("s"))
    record = record.withColumn("sample", sample.scalar())
    if include_describe:
        statistics = describe(saved, approx=approx)
        stats = statistics.agg(F.collect_list(F.struct(*[col(c) for c in statistics.columns])).alias("d"))
        record = record.withColumn("describe", stats.scalar())
    record.write.json(result.metadata)
    return result
