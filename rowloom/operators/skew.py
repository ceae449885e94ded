"""Equi-joins of tables whose heaviest keys are heavy on both sides, and totals over their pairs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.errors import ToolkitError
from rowloom.functions.columns import col, present, require
from rowloom.operators.joins import HOW, join
from rowloom.session import materialize

# A key with more than this share of a side's rows is heavy.
SHARE = 0.01
# Parts into which a side's rows of one key are dealt, at most.
MOST_PARTS = 64


def _hash(df: DataFrame, names: Sequence[str], types: dict) -> Column:
    values = [present(df, n).cast(types[n]) for n in names]
    return F.xxhash64(F.concat(*[F.when(v.isNull(), "0").otherwise("1") for v in values]), *values)


def heavy_keys(df: DataFrame, hashed: Column, share: float) -> dict[int, float]:
    """Hashes of the keys with more than about ``share`` of the rows, and their shares.

    A frequent-items sketch counts in the tasks that read the rows; one sketch per task is all that is sent on. It keeps
    ten times as many counters as there can be heavy keys, so none of these is missed.
    """
    most = max(1, int(1 / share))
    tracked = min(1_000_000, 10 * most)
    row = df.select(hashed.alias("h")).agg(
        F.count(F.lit(1)).alias("n"), F.call_function("approx_top_k", F.col("h"), F.lit(most), F.lit(tracked)).alias("top")
    ).first()
    return {t["item"]: t["count"] / row["n"] for t in row["top"] or () if t["count"] > share * row["n"]}


def join_skewed(
    left: DataFrame,
    right: DataFrame,
    keys: str | Sequence[str],
    how: str = "inner",
    null_safe: bool = False,
    suffixes: tuple[str, str] = ("_x", "_y"),
    share: float = SHARE,
    parts: int = MOST_PARTS,
) -> DataFrame:
    """:func:`~rowloom.operators.joins.join` for tables in which a few keys own much of both sides.

    Keys with more than ``share`` of a side's rows (at most ``2 / share`` of them) are joined apart: a side's rows of
    such a key are dealt to parts by its share, and each part meets each part of the other side in a cell of its own, so
    a pair of rows meets once and no task has a whole key. All other keys are joined as usual, and rows of a key that the
    other side lacks, or without a key where missing keys do not match, take no part in any join. The rows of heavy keys
    are written with their parts, so that a task that runs again deals them alike.
    """
    if how not in HOW:
        raise ToolkitError(f"how must be one of {list(HOW)}, not {how!r}")
    if not 0 < share <= 1 or parts < 1:
        raise ToolkitError("share must lie between 0 and 1, parts must be positive")
    names = require(left, keys)
    require(right, keys)
    spark = left.sparkSession
    common = left.select(*[col(k) for k in names]).unionByName(right.select(*[col(k) for k in names])).schema
    types = {k: common[k].dataType for k in names}

    def complete(df: DataFrame) -> Column:
        if null_safe:
            return F.lit(True)
        return reduce(lambda a, b: a & b, [present(df, k).isNotNull() for k in names])

    a = left.where(complete(left)).withColumn("__hash", _hash(left, names, types))
    b = right.where(complete(right)).withColumn("__hash", _hash(right, names, types))
    shares = heavy_keys(a, F.col("__hash"), share), heavy_keys(b, F.col("__hash"), share)
    found = sorted({*shares[0], *shares[1]})
    cells = [(h, *[max(1, min(parts, round(s.get(h, 0.0) * parts))) for s in shares]) for h in found]
    heavy = F.broadcast(spark.createDataFrame(cells, "__hash long, __left int, __right int"))

    def dealt(df: DataFrame, own: str, other: str, name: str) -> DataFrame:
        rows = df.join(heavy, "__hash").withColumn(own, F.pmod(F.monotonically_increasing_id(), F.col(f"_{own}")).cast("int"))
        written = materialize(rows, name)
        return written.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"_{other}") - 1)))

    def bare(df: DataFrame, columns: Sequence[str], *more: str) -> DataFrame:
        return df.select(*[col(c) for c in columns], *more)

    rest_a, rest_b = (df.join(heavy, "__hash", "left_anti") for df in (a, b))
    out = join(bare(rest_a, left.columns), bare(rest_b, right.columns), names, how, null_safe, suffixes)
    grid_a, grid_b = dealt(a, "_left", "_right", "heavy-left"), dealt(b, "_right", "_left", "heavy-right")
    marks = ["_left", "_right"]
    met = join(bare(grid_a, left.columns, *marks), bare(grid_b, right.columns, *marks), [*names, *marks], "inner", null_safe, suffixes)
    out = out.unionByName(met.drop(*marks))

    def alone(df: DataFrame, grid: DataFrame, other: DataFrame, every: DataFrame, is_left: bool) -> DataFrame:
        """Rows without a partner: of heavy keys that the other side lacks, and without a key."""
        mark = "_right" if is_left else "_left"
        there = other.select("__hash").distinct()
        lacking = grid.where(F.col(mark) == 0).join(F.broadcast(there), "__hash", "left_anti")
        none = every.where(~complete(every))
        rows = bare(lacking, df.columns).unionByName(none)
        empty = (right if is_left else left).limit(0)
        sides = (rows, empty) if is_left else (empty, rows)
        return join(*sides, names, "left" if is_left else "right", null_safe, suffixes)

    if how in ("left", "outer"):
        out = out.unionByName(alone(left, grid_a, grid_b, left, True))
    if how in ("right", "outer"):
        out = out.unionByName(alone(right, grid_b, grid_a, right, False))
    return out


def join_totals(
    left: DataFrame, right: DataFrame, keys: str | Sequence[str], left_value: str, right_value: str, how: str = "inner", **options
) -> DataFrame:
    """Totals per key over the pairs of :func:`join_skewed`, which takes the ``options``.

    Columns: the keys, ``n`` (pairs, and rows without a partner), ``left_n`` and ``right_n`` (present values of each side in
    them), ``left_sum`` and ``right_sum``. The right rows of a key meet each left row as one class with their number and
    totals, so the work grows with the rows of the sides, not with the pairs of a key that is heavy on both.
    """
    names = require(left, keys)
    require(right, keys)
    require(left, [left_value])
    require(right, [right_value])
    rows = left.select(*[col(k) for k in names], col(left_value).alias("__value"))
    classes = right.groupBy(*[present(right, k).alias(k) for k in names]).agg(
        F.count(F.lit(1)).alias("__rows"), F.count(col(right_value)).alias("__n"), F.sum(col(right_value)).alias("__sum")
    )
    met = join_skewed(rows, classes, names, how, **options)
    pairs = F.coalesce("__rows", F.lit(1))
    return met.groupBy(*[col(k) for k in names]).agg(
        F.sum(pairs).alias("n"),
        F.coalesce(F.sum(F.when(F.col("__value").isNotNull(), pairs)), F.lit(0)).alias("left_n"),
        F.coalesce(F.sum("__n"), F.lit(0)).alias("right_n"),
        F.sum(F.col("__value") * pairs).alias("left_sum"),
        F.sum("__sum").alias("right_sum"),
    )
