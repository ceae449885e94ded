"""Comparing two tables: row differences and count reconciliation."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.errors import ToolkitError
from rowloom.functions.columns import as_text, col, is_floating, is_numeric, present, require, type_of
from rowloom.session import materialize

MAX_EXAMPLES = 200


@dataclass(frozen=True)
class Difference:
    """The parts of a table comparison; each is a lazy DataFrame."""

    keys: DataFrame
    summary: DataFrame
    examples: DataFrame


def _common_type(left: T.DataType, right: T.DataType) -> T.DataType | None:
    """A type in which the values of both compare as they are; None where only their texts do."""
    if is_floating(left) or is_floating(right):
        return T.DoubleType() if is_numeric(left) and is_numeric(right) else None
    if left == right and isinstance(left, (T.IntegralType, T.BooleanType, T.DateType, T.StringType, T.BinaryType)):
        return left
    if is_numeric(left) and is_numeric(right):
        digits = [(t.precision, t.scale) if isinstance(t, T.DecimalType) else (19, 0) for t in (left, right)]
        scale = max(s for _, s in digits)
        whole = max(p - s for p, s in digits)
        return T.DecimalType(whole + scale, scale) if whole + scale <= 38 else None
    return None


def _comparison(
    a: DataFrame, b: DataFrame, keys: str | Sequence[str], compare_cols: str | Sequence[str] | None
) -> tuple[list[str], list[str], Callable[[DataFrame, str], Column]]:
    """Key columns, compared columns, and the value of a side's column as it compares with the other side's."""
    names = require(a, keys)
    require(b, keys)
    if compare_cols is None:
        compared = [c for c in a.columns if c in b.columns and c not in names]
    else:
        compared = require(a, compare_cols)
        require(b, compare_cols)
        if set(compared) & set(names):
            raise ToolkitError("a key column cannot be compared")
    kinds = {c: _common_type(type_of(a, c), type_of(b, c)) for c in compared}

    def by_value(df: DataFrame, c: str) -> Column:
        # without a common type, texts are compared
        return as_text(df, c) if kinds[c] is None else present(df, c).cast(kinds[c])

    return names, compared, by_value


def diff_tables(
    a: DataFrame,
    b: DataFrame,
    keys: str | Sequence[str],
    compare_cols: str | Sequence[str] | None = None,
    max_changed: int = MAX_EXAMPLES,
) -> Difference:
    """Compare two tables by key.

    ``keys`` has one row per key with ``status`` (only_in_a, only_in_b, same, changed, duplicate)
    and ``changes``, an array of (column, value_a, value_b). ``summary`` counts them exactly;
    ``examples`` shows the first changed keys. Without ``compare_cols`` all shared non-key
    columns are compared; two missing values are equal. A key that occurs more than once on a
    side is counted as duplicate and not compared.

    Both sides are stacked and grouped once by key. Copies of a repeated key fold together
    before the shuffle, which no join would allow.
    """
    names, compared, by_value = _comparison(a, b, keys, compare_cols)

    def side(df: DataFrame, own: str, other: str) -> DataFrame:
        values = F.struct(
            F.lit(True).alias("__row"),
            *[F.struct(by_value(df, c).alias("v"), as_text(df, c).alias("t")).alias(c) for c in compared],
        )
        nothing = F.lit(None).cast(df.select(values.alias("v")).schema["v"].dataType)
        return df.select(
            *[col(k) for k in names],
            F.lit(1 if own == "a" else 0).cast("bigint").alias("__n_a"),
            F.lit(1 if own == "b" else 0).cast("bigint").alias("__n_b"),
            values.alias(f"__{own}"),
            nothing.alias(f"__{other}"),
        )

    grouped = (
        side(a, "a", "b")
        .unionByName(side(b, "b", "a"))
        .groupBy(*[col(k) for k in names])
        .agg(
            F.sum("__n_a").alias("__n_a"),
            F.sum("__n_b").alias("__n_b"),
            F.first("__a", ignorenulls=True).alias("__a"),
            F.first("__b", ignorenulls=True).alias("__b"),
        )
    )
    pairs = [(c, col("__a")[c], col("__b")[c]) for c in compared]
    cells = [
        F.struct(
            F.lit(c).alias("column"),
            x["t"].alias("value_a"),
            y["t"].alias("value_b"),
            (~x["v"].eqNullSafe(y["v"])).alias("differs"),
        )
        for c, x, y in pairs
    ]
    no_change = F.array().cast("array<struct<column:string,value_a:string,value_b:string>>")
    changes = no_change
    if cells:
        changes = F.transform(
            F.filter(F.array(*cells), lambda s: s["differs"]),
            lambda s: F.struct(s["column"].alias("column"), s["value_a"].alias("value_a"), s["value_b"].alias("value_b")),
        )
    twice = (F.col("__n_a") > 1) | (F.col("__n_b") > 1)
    both = (F.col("__n_a") == 1) & (F.col("__n_b") == 1)
    status = (
        F.when(twice, "duplicate")
        .when(F.col("__n_b") == 0, "only_in_a")
        .when(F.col("__n_a") == 0, "only_in_b")
        .when(F.size("changes") > 0, "changed")
        .otherwise("same")
    )
    keyed = (
        grouped.withColumn("changes", F.when(both, changes).otherwise(no_change))
        .withColumn("status", status)
        .select(*[col(k) for k in names], "status", "changes")
    )

    def number(condition: Column) -> Column:
        return F.count_if(condition)

    state = F.col("status")
    summary = keyed.agg(
        number(state == "only_in_a").alias("only_in_a"),
        number(state == "only_in_b").alias("only_in_b"),
        number(state.isin("same", "changed")).alias("in_both"),
        number(state == "changed").alias("changed"),
        number(state == "duplicate").alias("duplicate_keys"),
    )
    examples = (
        keyed.filter(state == "changed").orderBy(*[col(k) for k in names]).limit(max_changed).drop("status")
    )
    return Difference(keyed, summary, examples)


# Buckets of keys whose checksums are compared at each level.
BUCKETS = 1 << 16


def _digest(values: Sequence[Column], seed: int) -> Column:
    """A hash that tells missing values of different columns apart; both zeros are one value."""
    missing = F.concat(*[F.when(v.isNull(), "0").otherwise("1") for v in values])
    return F.xxhash64(F.lit(seed), missing, *values)


def diff_by_checksum(
    a: DataFrame,
    b: DataFrame,
    keys: str | Sequence[str],
    compare_cols: str | Sequence[str] | None = None,
    max_changed: int = MAX_EXAMPLES,
    buckets: int = BUCKETS,
) -> Difference:
    """:func:`diff_tables` for tables that are mostly equal: only rows near a difference are shuffled.

    Keys fall into buckets by their hash. Each task sums the hashes of its rows per bucket, so what is shuffled is one
    small row per bucket and task. Buckets whose sums agree hold the same rows on both sides. The rows of the others are
    summed once more in finer buckets, and only those of finer buckets that still differ are compared key by key. Two
    equal tables shuffle nothing but checksums; a thousand changes among ten billion rows shuffle some thousand rows.

    ``keys`` has the keys whose status is not ``same``; ``summary`` and ``examples`` are those of :func:`diff_tables`,
    but a key that is repeated alike on both sides, in a bucket without any difference, counts in ``in_both`` with each
    of its rows instead of as one duplicate. Sums are compared by their count and two of 64 bits. Both tables are read
    three times; the checksums are written.
    """
    names, compared, by_value = _comparison(a, b, keys, compare_cols)
    if buckets < 1:
        raise ToolkitError("buckets must be positive")
    key_types = a.select(*[col(k) for k in names]).unionByName(b.select(*[col(k) for k in names])).schema

    def plain(value: Column, dtype: T.DataType) -> Column:
        if is_floating(dtype):
            return value + F.lit(0.0).cast(dtype)  # one zero
        return value if not any(t in dtype.simpleString() for t in ("map<", "variant")) else value.cast("string")

    def hashed(df: DataFrame) -> DataFrame:
        own = [plain(col(k).cast(key_types[k].dataType), key_types[k].dataType) for k in names]
        placed = df.withColumn("__key", _digest(own, 1))
        values = placed.select(*[by_value(df, c).alias(f"v{i}") for i, c in enumerate(compared)]).schema
        cells = [plain(by_value(df, c), f.dataType) for c, f in zip(compared, values, strict=True)]
        first, second = _digest([*own, *cells], 2), _digest([*own, *cells], 3)
        placed = placed.withColumn("__coarse", F.pmod("__key", F.lit(buckets)))
        placed = placed.withColumn("__fine", F.pmod(F.xxhash64("__key"), F.lit(buckets)))
        return placed.withColumns({"__x": first, "__y": second})

    def checksums(x: DataFrame, y: DataFrame, by: Sequence[str], name: str) -> DataFrame:
        """Rows of each bucket on both sides, and whether they differ; hashes are summed in halves, which cannot overflow."""

        def side(df: DataFrame, sign: int) -> DataFrame:
            halves = [
                (F.shiftright("__x", 32), "x1"), (F.col("__x").bitwiseAND(0xFFFFFFFF), "x2"),
                (F.shiftright("__y", 32), "y1"), (F.col("__y").bitwiseAND(0xFFFFFFFF), "y2"),
            ]
            counts = [F.lit(int(sign > 0)).cast("bigint").alias("n_a"), F.lit(int(sign < 0)).cast("bigint").alias("n_b")]
            return df.select(*by, *counts, *[(value * sign).alias(out) for value, out in halves])

        sums = side(x, 1).unionByName(side(y, -1)).groupBy(*by)
        total = sums.agg(*[F.sum(c).alias(c) for c in ("n_a", "n_b", "x1", "x2", "y1", "y2")])
        equal = (F.col("n_a") == F.col("n_b")) & F.greatest(*[F.abs(c) for c in ("x1", "x2", "y1", "y2")]).eqNullSafe(0)
        return materialize(total.select(*by, "n_a", "n_b", equal.alias("equal")), name)

    def differing(df: DataFrame, sums: DataFrame, by: Sequence[str]) -> DataFrame:
        # at most as many rows as there are buckets on the first level, and as there are differences on the second
        return df.join(sums.where("NOT equal").select(*by), list(by), "left_semi")

    left, right = hashed(a), hashed(b)
    coarse = checksums(left, right, ["__coarse"], "checksums")
    left, right = differing(left, coarse, ["__coarse"]), differing(right, coarse, ["__coarse"])
    fine = checksums(left, right, ["__coarse", "__fine"], "fine-checksums")
    left = differing(left, fine, ["__coarse", "__fine"]).select(*[col(c) for c in a.columns])
    right = differing(right, fine, ["__coarse", "__fine"]).select(*[col(c) for c in b.columns])

    rest = diff_tables(left, right, names, compared, max_changed)
    whole = coarse.where("equal").select("n_a").unionByName(fine.where("equal").select("n_a"))
    equal_rows = whole.agg(F.coalesce(F.sum("n_a"), F.lit(0)).alias("n")).scalar()
    summary = rest.summary.withColumn("in_both", F.col("in_both") + equal_rows)
    return Difference(rest.keys.where("status <> 'same'"), summary, rest.examples)


@dataclass(frozen=True)
class Reconciliation:
    """Counts per key, their totals, and the worst mismatches; each a lazy DataFrame."""

    counts: DataFrame
    summary: DataFrame
    examples: DataFrame


def reconcile_counts(
    left: DataFrame, right: DataFrame, keys: str | Sequence[str], max_examples: int = MAX_EXAMPLES
) -> Reconciliation:
    """Rows per key on each side and ``diff = left - right``; missing keys form a group of their own.

    One grouping over both sides stacked, reduced before the shuffle, so hot keys cost nothing.
    """
    names = require(left, keys)
    require(right, keys)

    def side(df: DataFrame, is_left: bool) -> DataFrame:
        return df.select(
            *[col(k) for k in names],
            F.lit(int(is_left)).cast("bigint").alias("left_count"),
            F.lit(int(not is_left)).cast("bigint").alias("right_count"),
        )

    counts = (
        side(left, True)
        .unionByName(side(right, False))
        .groupBy(*[col(k) for k in names])
        .agg(F.sum("left_count").alias("left_count"), F.sum("right_count").alias("right_count"))
        .withColumn("diff", F.col("left_count") - F.col("right_count"))
    )
    zero = F.lit(0).cast("bigint")
    summary = counts.agg(
        F.coalesce(F.sum("left_count"), zero).alias("left_rows"),
        F.coalesce(F.sum("right_count"), zero).alias("right_rows"),
        F.count_if(F.col("left_count") > 0).alias("left_keys"),
        F.count_if(F.col("right_count") > 0).alias("right_keys"),
        F.count_if(F.col("diff") == 0).alias("matched_keys"),
        F.count_if(F.col("diff") != 0).alias("mismatched_keys"),
    )
    mismatches = counts.filter(F.col("diff") != 0)
    examples = mismatches.orderBy(F.abs("diff").desc(), *[col(k) for k in names]).limit(max_examples)
    return Reconciliation(counts, summary, examples)
