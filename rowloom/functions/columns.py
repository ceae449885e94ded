"""Column helpers: quoting, missing values, ordering, hashing, Python-style number text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.errors import ToolkitError, UnknownColumnError

OrderItem = str | tuple[str, str]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """A top-level column, whatever characters its name has."""
    return F.col(quoted(name))


def as_list(names: str | Sequence[str]) -> list[str]:
    return [names] if isinstance(names, str) else list(names)


def require(df: DataFrame, names: str | Sequence[str]) -> list[str]:
    """The names as a list; an error naming the known columns if one is absent."""
    wanted = as_list(names)
    absent = [n for n in wanted if n not in df.columns]
    if absent:
        raise UnknownColumnError(f"unknown columns {absent}; available: {df.columns}")
    return wanted


def type_of(df: DataFrame, name: str) -> T.DataType:
    require(df, name)
    return df.schema[name].dataType


def is_floating(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.FloatType, T.DoubleType))


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_time(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType))


def present(df: DataFrame, name: str) -> Column:
    """The column with NaN turned into null: one notion of "missing" for all operators."""
    if is_floating(type_of(df, name)):
        return F.when(~F.isnan(col(name)), col(name))
    return col(name)


def is_missing(df: DataFrame, name: str) -> Column:
    return present(df, name).isNull()


def as_text(df: DataFrame, name: str) -> Column:
    """Text form of a column; nested values as JSON."""
    dtype = type_of(df, name)
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        return F.to_json(col(name))
    return present(df, name).cast("string")


def ordering(df: DataFrame, order_by: OrderItem | Sequence[OrderItem], reverse: bool = False) -> list[Column]:
    """Sort columns from ``"name"`` or ``("name", "desc")`` items."""
    items = [order_by] if isinstance(order_by, (str, tuple)) else list(order_by)
    if not items:
        raise ToolkitError("order_by needs at least one column")
    result = []
    for item in items:
        name, direction = (item, "asc") if isinstance(item, str) else item
        if direction not in ("asc", "desc"):
            raise ToolkitError(f"order direction must be asc or desc, not {direction!r}")
        require(df, name)
        descending = (direction == "desc") != reverse
        result.append(col(name).desc_nulls_last() if descending else col(name).asc_nulls_first())
    return result


def with_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``withColumn`` for an expensive value that later filters use.

    Spark pushes a filter on a plain projection below it and so computes the value twice. It does
    not push one below a generator; the outer form, as it adds a filter of its own to the plain.
    """
    return df.withColumn(name, F.explode_outer(F.array(value)))


def hash_rank(df: DataFrame, key: str | Sequence[str], seed: int | str) -> list[Column]:
    """A repeatable pseudo-random order: MD5 of seed and key, then the key itself."""
    keys = require(df, key)
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[as_text(df, k) for k in keys]))
    return [digest, *[col(k) for k in keys]]


def python_number_text(number: Column) -> Column:
    """The text Python's ``repr`` gives for a double, from Spark's text of the same value.

    Both print the shortest digits that read back to the same value; they differ in when they
    switch to an exponent and in how they write it.
    """
    plain = number.cast("string")
    size = F.abs(number)
    digits = F.regexp_replace(
        F.regexp_replace(plain.try_cast("decimal(38,20)").cast("string"), "0+$", ""), r"\.$", ".0"
    )
    mantissa = F.regexp_replace(F.substring_index(plain, "E", 1), r"\.0$", "")
    exponent = F.substring_index(plain, "E", -1).try_cast("int")
    sign = F.when(exponent < 0, F.lit("-")).otherwise(F.lit("+"))
    power = F.abs(exponent).cast("string")
    padded = F.when(F.length(power) < 2, F.concat(F.lit("0"), power)).otherwise(power)
    return (
        F.when(~plain.contains("E"), plain)
        .when((size >= 1e-4) & (size < 1e16), digits)
        .otherwise(F.concat(mantissa, F.lit("e"), sign, padded))
    )
