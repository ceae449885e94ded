"""JSON text to columns: parse_json_column and flatten_envelope."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.errors import ToolkitError
from rowloom.functions.columns import col, require, type_of, with_once
from rowloom.functions.json_values import is_array_text, is_object_text
from rowloom.operators.json_ops import parsed
from rowloom.operators.quality import variant_path
from rowloom.session import materialize

ENVELOPE = ("partition", "offset", "timestamp", "key", "value", "headers")
_POSITION = ("partition", "offset", "timestamp", "key")
HEADERS = ("columns", "map")


def _stored(rows: DataFrame) -> DataFrame:
    """The parsed rows, written with their variants shredded: what reads them next reads neither input nor text again."""
    conf = rows.sparkSession.conf
    wanted = {"spark.sql.variant.writeShredding.enabled": "true", "spark.sql.variant.inferShreddingSchema": "true"}
    before = {name: conf.get(name, None) for name in wanted}
    try:
        for name, value in wanted.items():
            conf.set(name, value)
        return materialize(rows, "parsed")
    finally:
        for name, value in before.items():
            conf.unset(name) if value is None else conf.set(name, value)


def discover_schema(df: DataFrame, value: Column) -> T.StructType:
    """The merged schema of all JSON objects in a variant column, found in one distributed pass.

    A field whose type differs between rows comes out as variant. Values that are not objects
    are left out, as they have no fields.
    """
    return discover_fields(df, value)[0]


def discover_fields(df: DataFrame, value: Column) -> tuple[T.StructType, int]:
    """As :func:`discover_schema`, with the number of rows that have a value, from the same pass."""
    kind = F.schema_of_variant(value)
    objects = F.when(kind.startswith("OBJECT"), value)
    text, n_valid = df.agg(F.schema_of_variant_agg(objects), F.count(value)).first()
    if not text or not text.startswith("OBJECT<") or text == "OBJECT<>":
        return T.StructType([]), n_valid
    return T.StructType.fromDDL(_as_struct_text(text)[len("STRUCT<") : -1]), n_valid


def _as_struct_text(text: str) -> str:
    """``OBJECT<...>`` as ``STRUCT<...>``, leaving quoted field names alone."""
    pieces = text.split("`")
    pieces[::2] = [p.replace("OBJECT<", "STRUCT<") for p in pieces[::2]]
    return "`".join(pieces)


def _json_or_null(value: Column) -> Column:
    """Array as JSON text, null for an empty one."""
    text = F.to_json(value)
    return F.when(text != "[]", text)


def _leaf(variant: Column, path: Sequence[str], dtype: T.DataType) -> Column:
    """A field in its own type: arrays and mixed values as text, arrays empty as null."""
    where = variant_path(path)
    if isinstance(dtype, (T.ArrayType, T.StructType, T.MapType)):
        return _json_or_null(F.try_variant_get(variant, where, "variant"))
    if isinstance(dtype, T.VariantType):
        # scalars plainly, nested values as JSON; the text "[]" of a string value is kept
        text = F.try_variant_get(variant, where, "string")
        empty = (text == "[]") & F.schema_of_variant(F.try_variant_get(variant, where, "variant")).startswith("ARRAY")
        return F.when(~empty, text)
    if isinstance(dtype, T.NullType):
        return F.lit(None).cast("string")
    target = "double" if isinstance(dtype, T.DecimalType) else dtype.simpleString()
    return F.try_variant_get(variant, where, target)


def _leaves(schema: T.StructType, depth: int | None, path: tuple[str, ...] = ()) -> Iterator[tuple[tuple[str, ...], T.DataType]]:
    """Paths and types below a struct, opening nested structs ``depth`` times (None: always)."""
    for field in schema.fields:
        here = (*path, field.name)
        if isinstance(field.dataType, T.StructType) and (depth is None or depth > 0):
            yield from _leaves(field.dataType, None if depth is None else depth - 1, here)
        else:
            yield here, field.dataType


def parse_json_column(
    df: DataFrame,
    column: str,
    target_columns: Sequence[str] | Mapping[str, str] | None = None,
    expand_arrays: bool = False,
    schema: T.StructType | str | None = None,
) -> DataFrame:
    """Replace a JSON text column by columns for its fields.

    Rows with missing, blank or broken text are dropped; :func:`json_defects` counts them.
    ``target_columns`` are dotted paths, optionally with types; they always appear, null where
    absent. Otherwise all top-level fields appear, nested objects opened one level as ``a.b``,
    arrays as JSON text (an empty one as null); their names come from ``schema``, or the parsed rows
    are written once and read twice, for the names and for the result. With ``expand_arrays`` each array element becomes a row; elements that are
    text are parsed again and dropped if broken; an empty array gives no row. New fields replace
    columns of the same name. A pass for the names that finds no valid JSON at all is an error.
    """
    require(df, column)
    rows = _json_rows(df, column, expand_arrays)
    value = F.col("__json")
    if target_columns is not None:
        types = dict(target_columns) if isinstance(target_columns, Mapping) else {t: "string" for t in target_columns}
        fields = {t: _target(value, t, dtype) for t, dtype in types.items()}
    else:
        if schema is None:
            rows = _stored(rows.select(*[col(c) for c in df.columns if c != column], "__json"))
            schema, n_valid = discover_fields(rows, value)
            if not n_valid:
                raise ToolkitError(f"no valid JSON in column {column!r}")
        elif isinstance(schema, str):
            schema = T.StructType.fromDDL(schema)
        fields = {".".join(p): _leaf(value, p, t) for p, t in _leaves(schema, 1)}
    kept = [c for c in df.columns if c != column and c not in fields]
    return rows.select(*[col(c) for c in kept], *[c.alias(n) for n, c in fields.items()])


def _target(value: Column, path: str, dtype: str) -> Column:
    steps = path.split(".")
    if dtype != "string":
        return F.try_variant_get(value, variant_path(steps), dtype)
    return _leaf(value, steps, T.VariantType())


def _json_rows(df: DataFrame, column: str, expand_arrays: bool) -> DataFrame:
    """The rows with valid JSON and their value as ``__json``.

    ``explode_outer`` with a later filter, because Spark adds a filter of its own to a plain
    ``explode`` and would parse every text twice to evaluate it.
    """
    value = F.col("__json")
    if not expand_arrays:
        return with_once(df, "__json", parsed(column)).filter(value.isNotNull())
    items = F.coalesce(F.try_variant_get(value, "$", "array<variant>"), F.array(value))
    text = F.try_variant_get(value, "$", "string")
    again = F.when(F.schema_of_variant(value) == "STRING", F.try_parse_json(text)).otherwise(value)
    exploded = (
        df.withColumn("__json", parsed(column))
        .withColumn("__array", is_array_text(col(column)))
        .withColumn("__json", F.explode_outer(items))
    )
    return with_once(exploded, "__json", F.when(F.col("__array"), again).otherwise(value)).filter(value.isNotNull())


def json_defects(df: DataFrame, column: str) -> DataFrame:
    """(rows, missing, invalid, valid) of a JSON text column."""
    require(df, column)
    text = col(column)
    missing = text.isNull() | (F.trim(text) == "")
    bad = parsed(column).isNull()
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(missing).alias("missing"),
        F.count_if(bad & ~missing).alias("invalid"),
        F.count_if(~bad).alias("valid"),
    )


def _unprintable(text: Column) -> Column:
    return text.rlike(r"[\p{C}\p{Z}&&[^ ]]")


def _named_header(entry: Column) -> Column:
    """A header under the name that its column would have."""
    name, text = F.concat(F.lit("header_"), entry["key"]), entry["value"]
    encoded = F.struct(F.concat(name, F.lit("_base64")).alias("key"), F.base64(F.encode(text, "UTF-8")).alias("value"))
    return F.when(_unprintable(text), encoded).otherwise(F.struct(name.alias("key"), text.alias("value")))


def flatten_envelope(
    df: DataFrame,
    schema: T.StructType | str | None = None,
    header_names: Sequence[str] | None = None,
    headers: str = "columns",
) -> DataFrame:
    """Event envelopes to flat columns: position and key first, the rest in alphabetical order.

    Object fields of ``value`` are opened at every level with ``_``, arrays become JSON text (an
    empty one null). Other JSON and plain text goes to ``value``. A header becomes
    ``header_<name>``, or ``header_<name>_base64`` where its text has control characters or line
    breaks. A field named like an envelope column or a header's column gets the prefix ``value_``.
    Where two fields meet in one name, the first present value counts, as text if their types
    differ. Missing positions stay null.

    ``schema`` and ``header_names`` say what to look for; a stream needs both. What is not given is
    discovered: the parsed events are written once, then read for the names and for the result. With
    ``headers="map"`` all headers come as one map column ``headers`` with the same names and values,
    which suits producers that write ids into the names, and no names are looked for.
    """
    require(df, ENVELOPE)
    if headers not in HEADERS:
        raise ToolkitError(f"headers must be one of {list(HEADERS)}, not {headers!r}")
    given = col("headers")
    if not isinstance(type_of(df, "headers"), T.MapType):
        given = F.from_json(given, "map<string,string>")
    rows = with_once(df, "__json", parsed("value")).withColumn("__headers", given)
    variant = F.col("__json")
    if headers == "map":
        header_names = header_names or []
    if schema is None or header_names is None:
        rows = _stored(rows.select(*[col(c) for c in _POSITION], "value", "__json", "__headers"))

    if schema is None:
        schema = discover_schema(rows, variant)
    elif isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    if header_names is None:
        names = rows.select(F.explode(F.map_keys("__headers")).alias("h")).distinct()
        header_names = sorted(r["h"] for r in names.collect())

    reserved = {*_POSITION, "value", *(["headers"] if headers == "map" else []), *(f"header_{n}{end}" for n in header_names for end in ("", "_base64"))}
    met: dict[str, list[tuple[tuple[str, ...], T.DataType]]] = {}
    for path, dtype in _leaves(schema, None):
        name = "_".join(path)
        met.setdefault(f"value_{name}" if name in reserved else name, []).append((path, dtype))

    outputs: dict[str, Column] = {}
    for name, leaves in met.items():
        # two paths may meet in one name, such as a_b and a.b
        cells = [_leaf(variant, p, t) for p, t in leaves]
        if len({t.simpleString() for _, t in leaves}) > 1:
            cells = [c.cast("string") for c in cells]
        outputs[name] = F.coalesce(*cells)

    is_json = variant.isNotNull()
    whole = F.when(is_json & is_array_text(col("value")), F.to_json(variant)).otherwise(col("value"))
    outputs["value"] = F.when((col("value") != "") & ~(is_json & is_object_text(col("value"))), whole)

    for name in header_names:
        text = F.when(F.col("__headers")[name] != "", F.col("__headers")[name])
        outputs[f"header_{name}"] = F.when(~_unprintable(text), text)
        outputs[f"header_{name}_base64"] = F.when(_unprintable(text), F.base64(F.encode(text, "UTF-8")))
    if headers == "map":
        filled = F.filter(F.map_entries("__headers"), lambda e: e["value"] != "")
        outputs["headers"] = F.map_from_entries(F.transform(filled, _named_header))

    clash = set(outputs) & set(_POSITION)
    if clash:
        raise ToolkitError(f"output names clash with the envelope: {sorted(clash)}")
    return rows.select(*[col(c) for c in _POSITION], *[outputs[n].alias(n) for n in sorted(outputs)])
