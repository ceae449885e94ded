"""Facts about JSON values, cheap enough to take on every row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed codes of the JSON types; numbers come last, so that one comparison finds them.
TYPE_CODES = {"null": 0, "boolean": 1, "string": 2, "array": 3, "object": 4, "number": 5, "integer": 6}


def first_sign(text: Column) -> Column:
    """The first character of a JSON text that is not white space."""
    return F.substring(F.ltrim(text, F.lit(" \t\r\n")), 1, 1)


def is_object_text(text: Column) -> Column:
    """Whether a text that is known to be JSON holds an object."""
    return first_sign(text) == "{"


def is_array_text(text: Column) -> Column:
    return first_sign(text) == "["


def schema_text(value: Column, text: Column | None = None) -> Column:
    """The schema of a value; only its kind where the JSON text tells that it is nested.

    Spelling out the schema of a whole event costs more than parsing it.
    """
    schema = F.schema_of_variant(value)
    if text is None:
        return schema
    return F.when(is_object_text(text), "OBJECT").when(is_array_text(text), "ARRAY").otherwise(schema)


def type_code(value: Column, schema: Column) -> Column:
    """The code of a value's JSON type; null when the value is absent."""
    code = {name: F.lit(number) for name, number in TYPE_CODES.items()}
    number = F.try_variant_get(value, "$", "double")
    kind = F.substring(schema, 1, 2)
    return (
        F.when(schema.isNull(), None)
        .when(kind == "ST", code["string"])
        .when(kind == "BI", code["integer"])
        .when(kind == "OB", code["object"])
        .when(kind == "AR", code["array"])
        .when(kind == "BO", code["boolean"])
        .when(kind == "VO", code["null"])
        .when(number == F.floor(number), code["integer"])  # 2.0 is an integer in JSON Schema
        .otherwise(code["number"])
    )
