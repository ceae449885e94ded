"""Path expressions on JSON values, turned into Columns.

Documented forms only: ``a.b``, ``a[0]``, ``a[-1]``, ``a[*].b``, ``a[?x > `5`].b`` and a final
``{out: path, ...}``. Names with other characters go in double quotes. Anything else is an error.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from rowloom.errors import ToolkitError

_NAME = r'[A-Za-z_][A-Za-z0-9_]*|"(?:[^"\\])+"'
_STEP = re.compile(
    rf"""\.?(?P<field>{_NAME})
      | \[(?P<index>-?\d+)\]
      | (?P<each>\[\*\])
      | \[\?\s*(?P<path>(?:{_NAME})(?:\.(?:{_NAME}))*)\s*(?P<op>==|!=|<=|>=|<|>)\s*
          (?P<literal>`[^`]*`|'[^']*')\s*\]
      | \.?\{{(?P<object>[^{{}}]*)\}}$""",
    re.VERBOSE,
)
_MEMBER = re.compile(rf"\s*(?P<name>{_NAME})\s*:\s*(?P<path>[^,]+?)\s*(?:,|$)")


def _unquote(name: str) -> str:
    return name[1:-1] if name.startswith('"') else name


def _field(value: Column, name: str) -> Column:
    return F.try_variant_get(value, f'$["{name}"]', "variant")


def _items(value: Column) -> Column:
    """The elements; null for anything that is not an array."""
    return F.try_variant_get(value, "$", "array<variant>")


def _literal(text: str) -> Any:
    if text.startswith("'"):
        return text[1:-1]
    try:
        return json.loads(text[1:-1])
    except json.JSONDecodeError as error:
        raise ToolkitError(f"not a JSON literal: {text}") from error


def compare_value(value: Column, op: str, literal: Any) -> Column:
    """Compare a JSON value with a Python literal of the same JSON type; other types never match.

    Order comparisons are for numbers only, ``!=`` is true for values of another type and for
    absent ones.
    """
    kind = F.schema_of_variant(value)
    if isinstance(literal, bool):
        same = F.when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean") == F.lit(literal))
    elif literal is None:
        same = value.isNull() | F.is_variant_null(value)
    elif isinstance(literal, (int, float)):
        is_number = (kind == "BIGINT") | (kind == "DOUBLE") | kind.startswith("DECIMAL")
        exact = isinstance(literal, int) and -(2**63) <= literal < 2**63
        number = F.when(is_number, F.try_variant_get(value, "$", "decimal(38,10)" if exact else "double"))
        other = F.lit(literal).cast("decimal(38,10)") if exact else F.lit(float(literal))
        order = {"<": number < other, "<=": number <= other, ">": number > other, ">=": number >= other}
        if op in order:
            return F.coalesce(order[op], F.lit(False))
        same = number == other
    elif isinstance(literal, str):
        same = F.when(kind == "STRING", F.try_variant_get(value, "$", "string") == F.lit(literal))
    else:
        raise ToolkitError("only scalar literals can be compared")
    if op not in ("==", "!="):
        raise ToolkitError(f"operator {op!r} needs a number, not {literal!r}")
    same = F.coalesce(same, F.lit(False))
    return same if op == "==" else ~same


@dataclass(frozen=True)
class Extracted:
    """A value found by a path: one JSON value, or the array a projection gives."""

    column: Column
    projected: bool

    def cast(self, target: str) -> Column:
        """The value in a Spark type; text holds scalars plainly and nested values as JSON."""
        if self.projected:
            if target == "variant":
                return F.to_variant_object(self.column)
            if target.startswith("array<"):
                inner = target[len("array<") : -1]
                if inner == "variant":
                    return self.column
                return F.transform(self.column, lambda v: F.try_variant_get(v, "$", inner))
            if target == "string":
                return F.to_json(self.column)
            raise ToolkitError(f"a projection gives an array, not {target}")
        if target == "variant":
            return self.column
        return F.try_variant_get(self.column, "$", target)


def extract(value: Column, path: str) -> Extracted:
    """Follow a path from a variant column."""
    column, projected = value, False
    rest = path.strip()
    if not rest:
        raise ToolkitError("the path is empty")
    if rest.startswith("."):
        raise ToolkitError(f"bad path {path!r}: it starts with a dot")

    def each(step):
        """Apply a step to the value, or to every element of a projection; absent results vanish.

        Steps take exactly one argument: ``transform`` would pass the index to a second one.
        """
        if not projected:
            return step(column)
        found = F.transform(column, step)
        return F.filter(found, lambda v: v.isNotNull() & ~F.is_variant_null(v))

    position = 0
    while position < len(rest):
        match = _STEP.match(rest, position)
        if match is None or match.end() == position:
            raise ToolkitError(f"bad path {path!r} at {rest[position:]!r}")
        if match["field"] and position > 0 and not match[0].startswith("."):
            raise ToolkitError(f"bad path {path!r}: a dot is missing before {match['field']!r}")
        if match["field"]:
            name = _unquote(match["field"])
            column = each(lambda v: _field(v, name))
        elif match["index"]:
            at = int(match["index"])
            if at >= 0:
                column = each(lambda v: F.try_variant_get(v, f"$[{at}]", "variant"))
            else:
                column = each(lambda v: F.try_element_at(_items(v), F.lit(at)))
        elif match["object"] is not None:
            members = _members(match["object"], path)
            column = each(lambda v: _object(v, members))
        else:
            if projected:
                raise ToolkitError(f"bad path {path!r}: only one projection is supported")
            column = _items(column)
            if match["op"]:
                inner, op, literal = match["path"], match["op"], _literal(match["literal"])
                column = F.filter(column, lambda v: compare_value(extract(v, inner).column, op, literal))
            projected = True
        position = match.end()
    return Extracted(column, projected)


def _members(text: str, path: str) -> list[tuple[str, str]]:
    members, position = [], 0
    while position < len(text):
        match = _MEMBER.match(text, position)
        if match is None:
            raise ToolkitError(f"bad path {path!r}: cannot read {text[position:]!r}")
        members.append((_unquote(match["name"]), match["path"]))
        position = match.end()
    if not members:
        raise ToolkitError(f"bad path {path!r}: the object has no members")
    return members


def _object(value: Column, members: list[tuple[str, str]]) -> Column:
    null = F.parse_json(F.lit("null"))
    cells = [F.coalesce(extract(value, p).cast("variant"), null).alias(n) for n, p in members]
    return F.when(value.isNotNull() & ~F.is_variant_null(value), F.to_variant_object(F.struct(*cells)))


def truthy(found: Extracted) -> Column:
    """False for absent, null, false, empty text, empty array and empty object; true otherwise."""
    if found.projected:
        return F.coalesce(F.size(found.column) > 0, F.lit(False))
    v = found.column
    empty = F.to_json(v).isin("null", "false", '""', "[]", "{}")
    return v.isNotNull() & ~F.coalesce(empty, F.lit(True))
