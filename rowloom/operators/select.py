"""Row selection: conditions, time ranges, head and tail, samples, previews."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date, datetime, time, timedelta, timezone
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.errors import ToolkitError
from rowloom.functions.columns import OrderItem, as_text, col, hash_rank, ordering, require, type_of
from rowloom.operators.numbering import first_per_group

PREVIEW_ROWS = 500

_COMPARE = {
    "==": lambda c, v: c == v,
    "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v,
    ">": lambda c, v: c > v,
    ">=": lambda c, v: c >= v,
}
OPERATORS = (*_COMPARE, "!=", "in", "contains", "startswith", "endswith")


def condition(df: DataFrame, column: str, op: str, value: Any, literal: bool = False) -> Column:
    """One condition as a boolean Column."""
    require(df, column)
    if op in _COMPARE:
        # the bare column, so that the comparison reaches the Parquet reader; NaN fails "==" and
        # sorts above every number in Spark, which the extra test takes back for > and >=
        plain = _COMPARE[op](col(column), F.lit(value))
        if op in (">", ">=") and isinstance(type_of(df, column), (T.FloatType, T.DoubleType)):
            return plain & ~F.isnan(col(column))
        return plain
    if op == "!=":
        return ~col(column).eqNullSafe(F.lit(value))
    if op == "in":
        if not isinstance(value, (list, tuple, set)):
            raise ToolkitError("operator 'in' needs a list of values")
        return col(column).isin(list(value))
    text = as_text(df, column)
    if op == "contains":
        return text.contains(value) if literal else text.rlike(value)
    if op == "startswith":
        return text.startswith(value)
    if op == "endswith":
        return text.endswith(value)
    raise ToolkitError(f"unknown operator {op!r}; known: {list(OPERATORS)}")


def filter_rows(df: DataFrame, conditions: Sequence[Mapping[str, Any]]) -> DataFrame:
    """Rows that meet every condition ``{"column", "op", "value"[, "literal"]}``.

    ``!=`` keeps rows without a value, all other operators drop them. ``contains`` is a regular
    expression unless ``literal`` is true.
    """
    parts = [condition(df, c["column"], c["op"], c.get("value"), c.get("literal", False)) for c in conditions]
    return df.filter(reduce(lambda a, b: a & b, parts)) if parts else df


def _instant(value: str | date | datetime) -> datetime:
    if isinstance(value, datetime):
        return value
    if isinstance(value, date):
        return datetime.combine(value, time())
    try:
        return datetime.fromisoformat(value)
    except (TypeError, ValueError) as error:
        raise ToolkitError(f"not a time: {value!r}") from error


def _utc_naive(value: datetime) -> datetime:
    return value.astimezone(timezone.utc).replace(tzinfo=None) if value.tzinfo else value


def filter_time_range(
    df: DataFrame,
    ts: str,
    start: str | date | datetime | None = None,
    end: str | date | datetime | None = None,
) -> DataFrame:
    """Rows with ``start <= ts <= end``; both bounds optional and inclusive.

    The bounds take the column's type, never the other way round, so that Parquet statistics
    and partition pruning stay usable. A text column has to be parsed; bad text is an error.
    """
    dtype = type_of(df, ts)
    column = col(ts)
    low = _instant(start) if start is not None else None
    high = _instant(end) if end is not None else None

    if isinstance(dtype, T.DateType):
        low = low and (_utc_naive(low) + timedelta(days=1, microseconds=-1)).date()
        high = high and _utc_naive(high).date()
        bound = F.lit
    elif isinstance(dtype, T.TimestampNTZType):
        bound = lambda v: F.lit(_utc_naive(v).isoformat(sep=" ")).cast("timestamp_ntz")
    elif isinstance(dtype, (T.TimestampType, T.StringType)):
        bound = lambda v: F.lit(v.isoformat(sep=" ")).cast("timestamp")
        if isinstance(dtype, T.StringType):
            column = F.to_timestamp(column)
    else:
        raise ToolkitError(f"column {ts!r} has type {dtype.simpleString()}, not a time")

    if low is not None:
        df = df.filter(column >= bound(low))
    if high is not None:
        df = df.filter(column <= bound(high))
    return df


def head_tail(
    df: DataFrame, order_by: OrderItem | Sequence[OrderItem], head: int | None = 5, tail: int | None = None
) -> DataFrame:
    """First ``head`` and last ``tail`` rows in a total order, with ``section`` and ``total_rows``.

    Each side is a top-k: every task keeps its own k rows and no full sort takes place.
    """
    if (head or 0) < 0 or (tail or 0) < 0:
        raise ToolkitError("head and tail must not be negative")
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    first = df.orderBy(*ordering(df, order_by)).limit(head or 0)
    last = df.orderBy(*ordering(df, order_by, reverse=True)).limit(tail or 0)
    sections = first.withColumn("section", F.lit("head")).unionByName(last.withColumn("section", F.lit("tail")))
    return sections.withColumn("total_rows", total)


def sample_random(df: DataFrame, n: int, key: str | Sequence[str], seed: int = 0) -> DataFrame:
    """``n`` rows without replacement, the same ones for every partitioning of the input.

    ``key`` should identify a row. ``n`` above the row count gives all rows.
    """
    if n < 0:
        raise ToolkitError("n must not be negative")
    return df.orderBy(*hash_rank(df, key, seed)).limit(n)


def sample_fraction(df: DataFrame, fraction: float, seed: int = 0) -> DataFrame:
    """About ``fraction`` of the rows, without any shuffle; the cheap way for large samples."""
    if not 0 <= fraction <= 1:
        raise ToolkitError("fraction must lie between 0 and 1")
    return df.sample(withReplacement=False, fraction=fraction, seed=seed)


def sample_stratified(
    df: DataFrame, strata: str | Sequence[str], n: int, key: str | Sequence[str], seed: int = 0
) -> DataFrame:
    """Up to ``n`` rows for each combination of the strata columns, which stay in the result.

    A stratum that holds most of the table is cut down in many tasks before it meets in one.
    """
    if n < 0:
        raise ToolkitError("n must not be negative")
    groups = [col(s) for s in require(df, strata)]
    return first_per_group(df, groups, hash_rank(df, key, seed), n, "__rank").drop("__rank")


def preview(df: DataFrame, n: int = PREVIEW_ROWS) -> DataFrame:
    """At most ``n`` rows, limited inside the plan."""
    if n < 0:
        raise ToolkitError("n must not be negative")
    return df.limit(n)
