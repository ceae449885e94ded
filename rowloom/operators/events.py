"""Identity of events: fingerprints, deduplication, correlation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.errors import ToolkitError
from rowloom.functions.columns import OrderItem, as_list, col, is_floating, is_missing, ordering, python_number_text, require, type_of, with_once
from rowloom.functions.paths import extract
from rowloom.operators.json_ops import parsed
from rowloom.operators.numbering import first_per_group, number_within


def _lower_escapes(text: Column) -> Column:
    """Unicode escapes in lower case; an escaped backslash before a ``u`` is no escape."""

    def lowered(part: Column) -> Column:
        pieces = F.transform(
            F.split(part, r"\\u"),
            lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.lower(F.substring(p, 1, 4)), F.substr(p, F.lit(5)))),
        )
        return F.when(part.contains("\\u"), F.array_join(pieces, "\\u")).otherwise(part)

    # Escaped backslashes are matched from the left, pair by pair; between them a backslash starts an escape.
    parts = F.transform(F.split(text, r"\\\\"), lowered)
    return F.when(text.contains("\\u"), F.array_join(parts, "\\\\")).otherwise(text)


def _json_string(value: Column) -> Column:
    """A quoted JSON string with every non-ASCII character escaped in lower case."""
    wrapped = F.to_json(F.struct(value.alias("x")), {"writeNonAsciiCharacterAsCodePoint": "true"})
    inner = F.substr(wrapped, F.lit(len('{"x":') + 1), F.length(wrapped) - len('{"x":}'))
    return _lower_escapes(F.replace(inner, F.lit("\x7f"), F.lit("\\u007f")))


def canonical_json(value: Column, dtype: T.DataType) -> Column:
    """JSON text with sorted keys and the separators ``", "`` and ``": "``; null as ``null``."""
    if isinstance(dtype, T.StructType):
        fields = sorted(dtype.fields, key=lambda f: f.name)
        cells = [
            F.concat(_json_string(F.lit(f.name)), F.lit(": "), canonical_json(value[f.name], f.dataType)) for f in fields
        ]
        text = F.concat(F.lit("{"), F.concat_ws(", ", *cells), F.lit("}"))
    elif isinstance(dtype, T.ArrayType):
        items = F.transform(value, lambda v: canonical_json(v, dtype.elementType))
        text = F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))
    elif isinstance(dtype, T.MapType):
        keys = F.array_sort(F.map_keys(value))
        cells = F.transform(
            keys,
            lambda k: F.concat(_json_string(k.cast("string")), F.lit(": "), canonical_json(value[k], dtype.valueType)),
        )
        text = F.concat(F.lit("{"), F.array_join(cells, ", "), F.lit("}"))
    elif isinstance(dtype, (T.BooleanType, T.IntegralType)):
        text = value.cast("string")
    elif is_floating(dtype):
        number = value.cast("double")
        text = F.when(F.isnan(number), "NaN").otherwise(python_number_text(number))
    elif isinstance(dtype, T.NullType):
        text = F.lit(None).cast("string")
    else:
        text = _json_string(value.cast("string"))
    return F.coalesce(F.when(value.isNotNull(), text), F.lit("null"))


def fingerprint(df: DataFrame, fields: str | Sequence[str] | None = None, output: str = "fingerprint") -> DataFrame:
    """Adds the SHA-256 hex digest of the record as sorted-key JSON, over all or chosen fields.

    Chosen fields that the table does not have are left out.
    """
    names = df.columns if fields is None else [f for f in as_list(fields) if f in df.columns]
    cells = [
        F.concat(_json_string(F.lit(n)), F.lit(": "), canonical_json(col(n), type_of(df, n))) for n in sorted(names)
    ]
    text = F.concat(F.lit("{"), F.concat_ws(", ", *cells), F.lit("}"))
    return df.withColumn(output, F.sha2(text, 256))


def _with_id(df: DataFrame, id_cols: str | Sequence[str] | None, column: str | None, path: str | None) -> tuple[DataFrame, Column]:
    """The table with ``__id`` parts and the condition that the id is there."""
    if (id_cols is None) == (path is None):
        raise ToolkitError("give either id columns or a JSON column with a path")
    if path is not None:
        require(df, column)
        # a JSON object prints with sorted keys, so ids that are objects compare by content
        found = F.to_json(extract(parsed(column), path).cast("variant"))
        keyed = with_once(df, "__id", F.when(found != "null", found))
        return keyed, F.col("__id").isNotNull()
    names = require(df, id_cols)
    keyed = df.withColumn("__id", F.struct(*[col(n) for n in names]))
    there = F.lit(True)
    for name in names:
        there = there & ~is_missing(df, name)
    return keyed, there


def dedupe_by_id(
    df: DataFrame,
    order_by: OrderItem | Sequence[OrderItem],
    id_cols: str | Sequence[str] | None = None,
    column: str | None = None,
    path: str | None = None,
) -> DataFrame:
    """The first record per id in the given order; records without id are skipped.

    The id is one or more columns, or the value at a path of a JSON column. Each task keeps one
    row per id before the shuffle, so an id with millions of copies sends one per task.
    """
    keyed, there = _with_id(df, id_cols, column, path)
    # plain columns as keys: a table clustered by them needs no shuffle
    keys = [F.col("__id")] if path is not None else [col(n) for n in as_list(id_cols)]
    return first_per_group(keyed.filter(there), keys, ordering(df, order_by), 1, "__rank").drop("__id", "__rank")


def dedupe_counts(
    df: DataFrame, id_cols: str | Sequence[str] | None = None, column: str | None = None, path: str | None = None
) -> DataFrame:
    """(original_count, unique_count, skipped_count) of a deduplication."""
    keyed, there = _with_id(df, id_cols, column, path)
    copies = keyed.groupBy(F.when(there, F.col("__id")).alias("id")).agg(F.count(F.lit(1)).alias("n"))
    missing = F.col("id").isNull()
    return copies.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("original_count"),
        F.count_if(~missing).alias("unique_count"),
        F.coalesce(F.sum(F.when(missing, F.col("n"))), F.lit(0)).alias("skipped_count"),
    )


def _pooled(batches: Sequence[DataFrame], key: str, ts: str, tie: Sequence[str]) -> DataFrame:
    if not batches:
        raise ToolkitError("at least one batch is needed")
    parts = []
    for i, batch in enumerate(batches):
        require(batch, [key, ts, *tie])
        parts.append(
            batch.filter(col(key).isNotNull() & col(ts).isNotNull()).select(
                col(key).alias("join_key"),
                col(ts).alias("event_time"),
                F.lit(i).alias("batch"),
                *[col(t).alias(f"__tie_{n}") for n, t in enumerate(tie)],
                F.struct(*[col(c) for c in batch.columns]).alias("record"),
            )
        )
    pooled = parts[0]
    for part in parts[1:]:
        pooled = pooled.unionByName(part)
    return pooled


def correlate(
    batches: Sequence[DataFrame], key: str, ts: str = "timestamp", tie: str | Sequence[str] = ()
) -> DataFrame:
    """Events of all batches whose key occurs more than once, numbered by time within their key.

    Columns: ``join_key, event_count, event_index, batch, event_time, record``. Records without
    key or time are left out. ``tie`` names columns that order events of the same time and batch.
    Batches need the same columns.

    A key may own most of the events: numbering works on ranges of (key, time), so such a key is
    spread over many tasks (see :func:`number_within`).
    """
    ties = as_list(tie)
    numbered = number_within(
        _pooled(batches, key, ts, ties),
        ["join_key"],
        ["event_time", "batch", *[f"__tie_{n}" for n in range(len(ties))]],
        position="event_index",
        total="event_count",
    )
    return numbered.filter(F.col("event_count") > 1).select(
        "join_key", "event_count", "event_index", "batch", "event_time", "record"
    )


def correlate_nested(
    batches: Sequence[DataFrame], key: str, ts: str = "timestamp", tie: str | Sequence[str] = (), part_size: int = 1000
) -> DataFrame:
    """As :func:`correlate` with the events of a key in arrays of at most ``part_size``.

    Columns: ``join_key, event_count, part, events``. A short key has one part; a long one has
    several, so that no row or task has to hold all its events.
    """
    if part_size < 1:
        raise ToolkitError("part_size must be positive")
    long = correlate(batches, key, ts, tie)
    part = F.floor((F.col("event_index") - 1) / part_size).cast("int")
    event = F.struct("event_index", "batch", "event_time", "record")
    return (
        long.withColumn("part", part)
        .groupBy("join_key", "event_count", "part")
        .agg(F.array_sort(F.collect_list(event), lambda a, b: (a["event_index"] - b["event_index"]).cast("int")).alias("events"))
    )
