"""Operators on JSON text columns: extract, filter and group by path."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.errors import ToolkitError
from rowloom.functions.columns import OrderItem, col, ordering, require, with_once
from rowloom.functions.paths import compare_value, extract, truthy
from rowloom.operators.numbering import first_per_group

EXAMPLES = 10


def parsed(column: str) -> Column:
    """The JSON value of a text column; null where the text is not JSON."""
    return F.try_parse_json(col(column))


def json_extract(
    df: DataFrame, column: str, outputs: Mapping[str, str], types: Mapping[str, str] | None = None
) -> DataFrame:
    """Adds one column per ``{name: path}``; absent values and bad JSON give null.

    Types are Spark type names, ``string`` by default; a projection may also be ``array<...>``.
    The text is parsed once per row.
    """
    require(df, column)
    if not outputs:
        raise ToolkitError("no output paths given")
    types = types or {}
    kept = [c for c in df.columns if c not in outputs]
    found = {n: extract(F.col("__json"), p).cast(types.get(n, "string")).alias(n) for n, p in outputs.items()}
    return with_once(df, "__json", parsed(column)).select(*[col(c) for c in kept], *found.values())


def filter_by_path(df: DataFrame, column: str, path: str, op: str | None = None, value: Any = None) -> DataFrame:
    """Rows whose value at the path passes; without an operator, rows where it is truthy.

    Operators are those of path filters (== != < <= > >=) plus ``in`` with a list. Rows whose
    text is not JSON are left out.
    """
    require(df, column)
    root = F.col("__json")
    found = extract(root, path)
    df = with_once(df, "__json", parsed(column))
    if op is None:
        return df.filter(truthy(found)).drop("__json")
    if found.projected:
        raise ToolkitError("a projection cannot be compared; use the path alone")
    if op == "in":
        if not isinstance(value, (list, tuple, set)) or not value:
            raise ToolkitError("operator 'in' needs a list of values")
        test = F.lit(False)
        for item in value:
            test = test | compare_value(found.column, "==", item)
    else:
        test = compare_value(found.column, op, value)
    return df.filter(root.isNotNull() & test).drop("__json")


def group_by_path(
    df: DataFrame,
    column: str,
    path: str,
    order_by: OrderItem | Sequence[OrderItem],
    max_groups: int | None = None,
    examples: int = EXAMPLES,
) -> DataFrame:
    """(group_key, n, examples): complete counts per value at the path, with the first records.

    All groups, or the largest ``max_groups``, ties by key. Counts are reduced before the
    shuffle. Example rows are ranked inside each task first, so a group of any size sends at
    most ``examples`` rows per task and the array stays that short.
    """
    require(df, column)
    key = extract(parsed(column), path).cast("string")
    keyed = with_once(df, "__key", key).filter(F.col("__key").isNotNull())
    counts = keyed.groupBy("__key").agg(F.count(F.lit(1)).alias("n"))
    if max_groups is not None:
        counts = counts.orderBy(F.col("n").desc(), "__key").limit(max_groups)
        # only rows of the keys shown need ranking
        keyed = keyed.join(counts.select("__key"), "__key", "left_semi")
    row = F.struct("__rank", F.struct(*[col(c) for c in df.columns]).alias("r"))
    first = (
        first_per_group(keyed, [F.col("__key")], ordering(df, order_by), examples, "__rank")
        .groupBy("__key")
        .agg(F.array_sort(F.collect_list(row), lambda a, b: a["__rank"] - b["__rank"]).alias("e"))
    )
    return counts.join(first, "__key", "left").select(
        F.col("__key").alias("group_key"), "n", F.transform("e", lambda s: s["r"]).alias("examples")
    )
