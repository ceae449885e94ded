"""Grouping, distinct counts, summary statistics and value counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.errors import ToolkitError
from rowloom.functions.columns import as_text, col, is_floating, is_missing, is_numeric, present, require, type_of
from rowloom.plans.inspect import is_scan

AGGREGATES = ("count", "size", "sum", "min", "max", "mean", "nunique")


def aggregate_column(df: DataFrame, column: str, agg: str, distinct_counts_null: bool = False) -> Column:
    """One aggregate over the non-missing values of a column."""
    value = present(df, column)
    if agg in ("sum", "mean") and isinstance(type_of(df, column), T.BooleanType):
        value = value.cast("int")
    if agg == "count":
        return F.count(value)
    if agg == "size":
        return F.count(F.lit(1))
    if agg == "sum":
        return F.coalesce(F.sum(value), F.lit(0))
    if agg == "min":
        return F.min(value)
    if agg == "max":
        return F.max(value)
    if agg == "mean":
        return F.avg(value)
    if agg == "nunique":
        distinct = F.count_distinct(value)
        if distinct_counts_null:
            distinct = distinct + F.coalesce(F.max(value.isNull().cast("int")), F.lit(0))
        return distinct
    raise ToolkitError(f"unknown aggregate {agg!r}; known: {list(AGGREGATES)}")


def group_aggregate(
    df: DataFrame,
    group_cols: str | Sequence[str],
    aggs: Mapping[str, str | Sequence[str]],
    drop_null_keys: bool = False,
    distinct_counts_null: bool = False,
) -> DataFrame:
    """``{column: aggregates}`` per group as columns ``{column}_{aggregate}``.

    Everything is reduced in the tasks before the shuffle; ``nunique`` first shuffles on
    (group, value), so one big group is spread over many tasks.
    """
    groups = require(df, group_cols)
    require(df, list(aggs))
    if not aggs:
        raise ToolkitError("at least one aggregate is needed")
    outputs = [
        aggregate_column(df, name, agg, distinct_counts_null).alias(f"{name}_{agg}")
        for name, wanted in aggs.items()
        for agg in ([wanted] if isinstance(wanted, str) else wanted)
    ]
    if drop_null_keys:
        for name in groups:
            df = df.filter(~is_missing(df, name))
    return df.groupBy(*[present(df, g).alias(g) for g in groups]).agg(*outputs)


DIGEST_ABOVE = 64
NARROW_SCANS = 200


def cell_rows(df: DataFrame, cells: Sequence[Mapping[str, Column]]) -> DataFrame:
    """One row per table row and cell; all cells have the same fields.

    Over plain files every cell gets its own narrow scan: together they read each column once and
    stay in simple generated code. Where the table comes from joins or groupings, which should
    not run once per column, each row is read once and opened into its cells.
    """
    if len(cells) <= NARROW_SCANS and is_scan(df):
        parts = [df.select(*[c.alias(n) for n, c in cell.items()]) for cell in cells]
        return reduce(lambda a, b: a.union(b), parts)
    return df.select(F.inline(F.array(*[F.struct(*[c.alias(n) for n, c in cell.items()]) for cell in cells])))


def _typed_cell(df: DataFrame, name: str, as_words: bool) -> tuple[Column, Column, Column]:
    """A cell as (whole number, double, text), one of them set; all null if missing.

    Numbers and times keep a fixed width, which makes grouping much cheaper than on text.
    """
    dtype, value = type_of(df, name), present(df, name)
    whole, double, text = (F.lit(None).cast(t) for t in ("bigint", "double", "string"))
    if as_words:
        text = as_text(df, name)
    elif isinstance(dtype, (T.IntegralType, T.BooleanType)):
        whole = value.cast("bigint")
    elif is_floating(dtype):
        double = value.cast("double")
    elif isinstance(dtype, T.DateType):
        whole = F.unix_date(value).cast("bigint")
    elif isinstance(dtype, T.TimestampType):
        whole = F.unix_micros(value)
    elif isinstance(dtype, T.TimestampNTZType):
        # without a detour through the session's zone, where two local times may be one instant
        seconds = F.unix_date(value.cast("date")).cast("bigint") * 86_400 + F.hour(value) * 3_600 + F.minute(value) * 60
        whole = seconds * 1_000_000 + (F.extract(F.lit("SECOND"), value) * 1_000_000).cast("bigint")
    else:
        text = as_text(df, name)
        text = F.when(F.length(text) > DIGEST_ABOVE, F.sha2(text, 256)).otherwise(text)
    return whole, double, text


def value_frequencies(df: DataFrame, columns: Sequence[str], as_words: bool = False) -> DataFrame:
    """(column, present, value, n) for every distinct value of the given columns, and for missing ones.

    One shuffle serves all columns, whatever their number. ``value`` holds the text form with
    ``as_words``. Without, it is meant for counting only: texts of more than 64 characters are
    told apart by their SHA-256, which keeps whole documents out of the shuffle. A row with n = 0
    per column is added so that a table without rows still lists its columns.
    """
    kinds = {"whole": "bigint", "double": "double", "text": "string"}

    def cell(i: int, values: Sequence[Column], one: int) -> dict[str, Column]:
        return {"at": F.lit(i), **dict(zip(kinds, values)), "one": F.lit(one).cast("bigint")}

    nothing = [F.lit(None).cast(t) for t in kinds.values()]
    names = df.sparkSession.range(1).select(
        F.inline(F.array(*[F.struct(*[c.alias(n) for n, c in cell(i, nothing, 0).items()]) for i in range(len(columns))]))
    )
    cells = cell_rows(df, [cell(i, _typed_cell(df, c, as_words), 1) for i, c in enumerate(columns)])
    return (
        cells.unionByName(names)
        .groupBy("at", "whole", "double", "text")
        .agg(F.sum("one").alias("n"))
        .select(
            F.array(*[F.lit(c) for c in columns])[F.col("at")].alias("column"),
            (F.col("whole").isNotNull() | F.col("double").isNotNull() | F.col("text").isNotNull()).alias("present"),
            F.col("text").alias("value"),
            "n",
        )
    )


def count_distinct(df: DataFrame, columns: str | Sequence[str] | None = None, approx: bool = False) -> DataFrame:
    """(column, distinct_count) over the non-missing values; all columns by default.

    ``approx`` keeps a sketch of fixed size per column and needs no shuffle of values.
    """
    names = require(df, columns) if columns is not None else df.columns
    if approx:
        counts = df.agg(*[F.approx_count_distinct(present(df, c)).alias(f"c{i}") for i, c in enumerate(names)])
        cells = [F.struct(F.lit(c).alias("column"), col(f"c{i}").alias("distinct_count")) for i, c in enumerate(names)]
        return counts.select(F.inline(F.array(*cells)))
    return value_frequencies(df, names).groupBy("column").agg(F.count_if("present").alias("distinct_count"))


def value_counts(df: DataFrame, column: str, top_k: int | None = None) -> DataFrame:
    """(value, n) by falling count, ties by value; missing values are not counted."""
    value = present(df, require(df, column)[0]).alias("value")
    counts = df.select(value).filter(F.col("value").isNotNull()).groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    if top_k is None:
        return counts
    return counts.orderBy(F.col("n").desc(), F.col("value")).limit(top_k)


# --- describe ---------------------------------------------------------------------------------

QUANTILES = (0.25, 0.5, 0.75)


def _quantile_name(q: float) -> str:
    return f"p{q * 100:g}"


BAND_PARTS = 1000


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], quantiles: Sequence[float] = QUANTILES, accuracy: int = 10_000
) -> DataFrame:
    """(column, q, value): exact quantiles with linear interpolation, in two distributed passes.

    The first pass sketches a narrow band around each quantile (rank error at most N/accuracy).
    The second counts the rows below each band and the distinct values inside it. Counts of
    equal-width parts of the band tell which part holds the quantile, and only the values of that
    part are put in order. The table is never sorted and no buffer holds all its values. Should a
    band miss its quantile, the query fails instead of giving a wrong number.
    """
    for q in quantiles:
        if not 0 <= q <= 1:
            raise ToolkitError("quantiles must lie between 0 and 1")
    slack = 3.0 / accuracy
    edges = [e for q in quantiles for e in (max(q - slack, 0.0), min(q + slack, 1.0))]
    values = [present(df, c).cast("double") for c in columns]
    sketch = df.agg(
        *[F.percentile_approx(v, edges, accuracy).alias(f"e{i}") for i, v in enumerate(values)],
        *[F.count(v).alias(f"n{i}") for i, v in enumerate(values)],
        *[F.min(v).alias(f"min{i}") for i, v in enumerate(values)],
        *[F.max(v).alias(f"max{i}") for i, v in enumerate(values)],
    )

    def edge(i: int, at: int, outer: str) -> Column:
        # a short column is its own band: there, one rank may be more than the slack
        return F.when(col(f"n{i}") <= accuracy, col(f"{outer}{i}")).otherwise(col(f"e{i}")[at])

    rows = [
        F.struct(
            F.lit(i).alias("at"),
            F.lit(float(q)).alias("q"),
            edge(i, 2 * j, "min").alias("low"),
            edge(i, 2 * j + 1, "max").alias("high"),
            (F.lit(float(q)) * (col(f"n{i}") - 1)).alias("position"),
        )
        for i in range(len(columns))
        for j, q in enumerate(quantiles)
    ]
    return quantiles_in_bands(df, columns, sketch.select(F.inline(F.array(*rows))))


def quantiles_in_bands(df: DataFrame, columns: Sequence[str], bands: DataFrame) -> DataFrame:
    """(column, q, value) where ``bands`` says between which values each quantile lies; the second pass of the above.

    ``bands`` has a row per column and quantile: ``at`` (place in ``columns``), ``q``, ``low``, ``high`` and the
    ``position`` of the quantile among the present values, counted from 0.
    """
    values = [present(df, c).cast("double") for c in columns]
    cells = cell_rows(df, [{"at": F.lit(i), "value": v} for i, v in enumerate(values)])
    inside = F.when(F.col("value") >= F.col("low"), F.col("value"))
    counted = (
        cells.filter(F.col("value").isNotNull())
        .join(F.broadcast(bands), "at")  # columns x quantiles rows
        .filter(F.col("value") <= F.col("high"))
        .groupBy("at", "q", "position", "low", "high", inside.alias("value"))  # null: all rows below the band
        .agg(F.count(F.lit(1)).alias("n"))
    )
    share = (F.col("value") - F.col("low")) / F.nullifzero(F.col("high") - F.col("low"))
    place = F.least(F.coalesce(F.floor(share * BAND_PARTS), F.lit(0)), F.lit(BAND_PARTS - 1))
    counted = counted.withColumn("part", F.when(F.col("value").isNull(), F.lit(-1)).otherwise(place).cast("int"))

    lower, upper = F.floor("position"), F.ceil("position")
    up_to = F.sum("n").over(Window.partitionBy("at", "q").orderBy("part").rowsBetween(Window.unboundedPreceding, 0))

    def holds(rank: Column) -> Column:
        return (F.col("up_to") > rank) & (F.col("up_to") - F.col("n") <= rank)

    parts = (
        counted.groupBy("at", "q", "position", "part")
        .agg(F.sum("n").alias("n"))
        .withColumn("up_to", up_to)
        .filter(holds(lower) | holds(upper))
        .select("at", "q", "part", (F.col("up_to") - F.col("n")).alias("before"))
    )
    order = Window.partitionBy("at", "q", "part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    picked = (
        counted.join(F.broadcast(parts), ["at", "q", "part"])  # at most two parts per band
        .withColumn("up_to", F.col("before") + F.sum("n").over(order))
        .groupBy("at", "q", "position")
        .agg(
            F.min("part").alias("first_part"),
            F.min(F.when(F.col("up_to") > lower, F.col("value"))).alias("a"),
            F.min(F.when(F.col("up_to") > upper, F.col("value"))).alias("b"),
        )
    )
    value = F.col("a") + (F.col("b") - F.col("a")) * (F.col("position") - lower)
    hit = (F.col("first_part") >= 0) & F.col("b").isNotNull()
    checked = F.when(hit, value).otherwise(F.raise_error(F.lit("quantile outside its band: lower the accuracy")).cast("double"))
    names = F.array(*[F.lit(c) for c in columns])
    return picked.select(names[F.col("at")].alias("column"), "q", checked.alias("value"))


def describe(
    df: DataFrame, columns: str | Sequence[str] | None = None, approx: bool = False, quantiles: Sequence[float] = QUANTILES
) -> DataFrame:
    """One row per column: count for all, mean/std/min/quantiles/max for numbers, unique/top/freq for the rest.

    ``approx`` takes quantiles from the sketch alone and so saves the second pass. ``top`` is the
    most frequent value, ties by the smaller value.
    """
    names = require(df, columns) if columns is not None else df.columns
    numeric = [c for c in names if is_numeric(type_of(df, c))]
    other = [c for c in names if c not in numeric]
    parts = []
    if numeric:
        parts.append(_describe_numbers(df, numeric, approx, quantiles))
    if other:
        frequencies = value_frequencies(df, other, as_words=True).groupBy("column").agg(
            F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("n"))), F.lit(0)).alias("count"),
            F.count("value").alias("unique"),
            F.min_by("value", F.when(F.col("value").isNotNull(), F.struct(-F.col("n"), F.col("value")))).alias("top"),
            F.max(F.when(F.col("value").isNotNull(), F.col("n"))).alias("freq"),
        )
        parts.append(frequencies)
    result = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
    known = T.StructType.fromJson(df.select(*[col(c) for c in names]).schema.jsonValue())
    dtypes = F.create_map(*[F.lit(x) for f in known.fields for x in (f.name, f.dataType.simpleString())])
    return result.withColumn("dtype", dtypes[F.col("column")])


def _describe_numbers(df: DataFrame, names: Sequence[str], approx: bool, quantiles: Sequence[float]) -> DataFrame:
    aggs: list[Column] = []
    for i, name in enumerate(names):
        v = present(df, name).cast("double")
        aggs += [
            F.count(v).alias(f"count{i}"),
            F.avg(v).alias(f"mean{i}"),
            F.stddev_samp(v).alias(f"std{i}"),
            F.min(v).alias(f"min{i}"),
            F.max(v).alias(f"max{i}"),
        ]
        if approx:
            aggs.append(F.percentile_approx(v, list(quantiles)).alias(f"q{i}"))
    cells = [
        F.struct(
            F.lit(name).alias("column"),
            *[col(f"{s}{i}").alias(s) for s in ("count", "mean", "std", "min", "max")],
            *([col(f"q{i}")[j].alias(_quantile_name(q)) for j, q in enumerate(quantiles)] if approx else []),
        )
        for i, name in enumerate(names)
    ]
    stats = df.agg(*aggs).select(F.inline(F.array(*cells)))
    if approx:
        return stats
    wide = exact_quantiles(df, names, quantiles).groupBy("column").agg(
        *[F.max(F.when(F.col("q") == float(q), F.col("value"))).alias(_quantile_name(q)) for q in quantiles]
    )
    return stats.join(F.broadcast(wide), "column", "left")  # one row per column on both sides
