"""As-of joins: each left row with the nearest right row of its key, by time."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowloom.errors import ToolkitError
from rowloom.functions.columns import as_list, col, require
from rowloom.session import materialize

DIRECTIONS = ("backward", "forward")
# Rows of a range of key and time, about; fewer rows in all are dealt to ranges by the session's number of partitions.
RANGE_ROWS = 100_000


def _hashable(df: DataFrame) -> list[Column]:
    return [col(f.name) for f in df.schema.fields if not any(t in f.dataType.simpleString() for t in ("map<", "variant"))]


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: str | Sequence[str],
    left_ts: str,
    right_ts: str | None = None,
    direction: str = "backward",
    allow_equal: bool = True,
    tolerance: str | None = None,
    how: str = "left",
    tie: str | Sequence[str] = (),
    suffixes: tuple[str, str] = ("_x", "_y"),
) -> DataFrame:
    """Left rows, each with the last right row of its key at or before its time (``forward``: the first at or after it).

    Without ``allow_equal`` a right row of the same time does not count. A right row further away than ``tolerance`` (an
    interval such as ``"2 hours"``) does not count. Left rows without a partner have nulls, or are left out by
    ``how="inner"``; a left row without key or time has none. Of right rows of one key and time the last by the ``tie``
    columns counts, else the last by a hash of the row.

    Both sides are stacked and range-partitioned by (key, time), so that a key that owns most of the rows is spread over
    many tasks, and written once. The ranges are as many as the rows ask for, so that no task's memory grows with them;
    counting takes a pass over keys and times. The last right row is carried forward inside each range. What comes before a range is
    the last right row of all earlier ones, so a row per range is all that crosses the borders. No pairs are built.
    """
    names = require(left, keys)
    require(right, keys)
    if direction not in DIRECTIONS:
        raise ToolkitError(f"direction must be one of {list(DIRECTIONS)}, not {direction!r}")
    if how not in ("left", "inner"):
        raise ToolkitError("how must be left or inner")
    right_ts = right_ts or left_ts
    require(left, [left_ts])
    ties = require(right, [right_ts, *as_list(tie)])[1:]
    clash = (set(left.columns) & set(right.columns)) - set(names)
    left_out = {c: c + suffixes[0] if c in clash else c for c in left.columns}
    right_out = {c: c + suffixes[1] if c in clash else c for c in right.columns if c not in names}
    if len({*left_out.values(), *right_out.values()}) != len(left_out) + len(right_out):
        raise ToolkitError("column names clash after suffixing")

    key_names = [f"__key{i}" for i in range(len(names))]
    left_row = F.struct(*[col(c).alias(f"c{i}") for i, c in enumerate(left.columns)])
    right_row = F.struct(*[col(c).alias(f"c{i}") for i, c in enumerate(right_out)], F.lit(True).alias("there"))
    left_type = left.select(left_row.alias("r")).schema["r"].dataType
    right_type = right.select(right_row.alias("r")).schema["r"].dataType

    def placed(ts: str) -> Column:
        complete = col(ts).isNotNull()
        for name in names:
            complete = complete & col(name).isNotNull()
        return complete

    def side(df: DataFrame, ts: str, is_right: bool) -> DataFrame:
        nothing_left, nothing_right = F.lit(None).cast(left_type), F.lit(None).cast(right_type)
        return df.where(placed(ts)).select(
            *[col(n).alias(k) for n, k in zip(names, key_names, strict=True)],
            col(ts).alias("__time"),
            # at equal times a right row comes first if it counts
            F.lit(int(is_right != allow_equal)).alias("__side"),
            (F.struct(*[col(t) for t in ties]) if is_right and ties else F.lit(None)).alias("__tie"),
            F.xxhash64(*_hashable(df)).alias("__hash"),
            (nothing_left if is_right else left_row).alias("__left"),
            (right_row if is_right else nothing_right).alias("__right"),
        )

    time = F.col("__time").asc() if direction == "backward" else F.col("__time").desc()
    order = [*key_names, time, "__side", "__tie", "__hash"]
    right_side, left_side = side(right, right_ts, True), side(left, left_ts, False)
    if ties:
        left_side = left_side.withColumn("__tie", F.lit(None).cast(right_side.schema["__tie"].dataType))
    both = left_side.unionByName(right_side)
    needed = 1 + both.select(F.count(F.lit(1))).first()[0] // RANGE_ROWS
    ranges = [needed] if needed > 1 else []
    both = both.repartitionByRange(*ranges, *order).sortWithinPartitions(*order)
    # high bits: number of the range; low 33 bits: row number inside it
    kept = both.select(*key_names, "__time", "__left", "__right", F.monotonically_increasing_id().alias("__at"))
    rows = materialize(kept, "asof").withColumn("__range", F.shiftright("__at", 33))

    found = F.struct(*key_names, "__time", "__right")
    is_right = F.col("__right").isNotNull()
    inside = Window.partitionBy("__range", *key_names).orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    dealt = rows.repartition(*ranges, "__range")
    near = dealt.withColumn("__near", F.last(F.when(is_right, found), ignorenulls=True).over(inside)).where("__left IS NOT NULL")

    # one row per range: the last right row before it
    last = rows.groupBy("__range").agg(F.max_by(F.when(is_right, found), F.when(is_right, F.col("__at"))).alias("__last"))
    earlier = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(F.col("__range").alias("__r"), F.last("__last", ignorenulls=True).over(earlier).alias("__carried"))
    same_key = F.lit(True)
    for k in key_names:
        same_key = same_key & (F.col(f"__carried.{k}") == F.col(k))
    joined = near.join(F.broadcast(carried), F.col("__range") == F.col("__r"))
    best = F.coalesce("__near", F.when(same_key, F.col("__carried")))
    if tolerance is not None:
        if not re.fullmatch(r"[\w .+-]+", tolerance):
            raise ToolkitError(f"{tolerance!r} is not an interval")
        reach = F.expr(f"INTERVAL '{tolerance}'")
        apart = F.col("__time") - reach <= best["__time"] if direction == "backward" else best["__time"] <= F.col("__time") + reach
        best = F.when(apart, best)
    matched = joined.select("__left", best["__right"].alias("__right"))
    if how == "inner":
        matched = matched.where("__right IS NOT NULL")
    else:
        alone = left.where(~placed(left_ts))
        matched = matched.unionByName(alone.select(left_row.alias("__left"), F.lit(None).cast(right_type).alias("__right")))
    return matched.select(
        *[F.col(f"__left.c{i}").alias(o) for i, o in enumerate(left_out.values())],
        *[F.col(f"__right.c{i}").alias(o) for i, o in enumerate(right_out.values())],
    )
