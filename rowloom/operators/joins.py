"""Equi-joins with pandas-like results, and key presence."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.errors import ToolkitError
from rowloom.functions.columns import col, present, require

HOW = ("inner", "left", "right", "outer")


def join(
    left: DataFrame,
    right: DataFrame,
    keys: str | Sequence[str],
    how: str = "inner",
    null_safe: bool = False,
    suffixes: tuple[str, str] = ("_x", "_y"),
) -> DataFrame:
    """Equi-join on same-named keys, which appear once; other clashing columns get the suffixes.

    With ``null_safe`` two missing keys match, so every left row without a key meets every right one: their
    numbers are multiplied. The null-safe comparison is still an equi-join.
    Build side and strategy are left to Spark's size statistics and AQE. AQE cannot split a hot
    key of a full outer join, so ``outer`` is a left join (which it can split) plus the right
    rows without a partner, found against the distinct left keys.
    """
    if how not in HOW:
        raise ToolkitError(f"how must be one of {list(HOW)}, not {how!r}")
    names = require(left, keys)
    require(right, keys)
    clash = (set(left.columns) & set(right.columns)) - set(names)
    left_out = {c: c + suffixes[0] if c in clash else c for c in left.columns if c not in names}
    right_out = {c: c + suffixes[1] if c in clash else c for c in right.columns if c not in names}
    final = [*names, *left_out.values(), *right_out.values()]
    if len(set(final)) != len(final):
        raise ToolkitError(f"column names clash after suffixing: {final}")

    lk = {k: f"__left_{i}" for i, k in enumerate(names)}
    rk = {k: f"__right_{i}" for i, k in enumerate(names)}
    a = left.select(*[present(left, k).alias(lk[k]) for k in names], *[col(c).alias(o) for c, o in left_out.items()])
    b = right.select(*[present(right, k).alias(rk[k]) for k in names], *[col(c).alias(o) for c, o in right_out.items()])

    def matches(x: DataFrame, y: DataFrame):
        pairs = [
            x[lk[k]].eqNullSafe(y[rk[k]]) if null_safe else x[lk[k]] == y[rk[k]] for k in names
        ]
        return reduce(lambda p, q: p & q, pairs)

    side = rk if how == "right" else lk
    joined = a.join(b, matches(a, b), "left" if how == "outer" else how).select(
        *[F.col(side[k]).alias(k) for k in names],
        *[col(o) for o in left_out.values()],
        *[col(o) for o in right_out.values()],
    )
    if how != "outer":
        return joined
    left_keys = a.select(*lk.values()).distinct()
    alone = b.join(left_keys, matches(left_keys, b), "left_anti")
    alone = alone.select(*[F.col(rk[k]).alias(k) for k in names], *[col(o) for o in right_out.values()])
    return joined.unionByName(alone, allowMissingColumns=True)


def key_presence(left: DataFrame, right: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    """Every distinct key with ``in_left`` and ``in_right``; missing keys count as equal.

    A union and one grouping instead of a full outer join: keys are reduced before the shuffle.
    """
    names = require(left, keys)
    require(right, keys)
    tagged = left.select(*[present(left, k).alias(k) for k in names], F.lit(True).alias("in_left"), F.lit(False).alias("in_right"))
    tagged = tagged.unionByName(
        right.select(*[present(right, k).alias(k) for k in names], F.lit(False).alias("in_left"), F.lit(True).alias("in_right"))
    )
    return tagged.groupBy(*[col(k) for k in names]).agg(
        F.max("in_left").alias("in_left"), F.max("in_right").alias("in_right")
    )
