"""Schema checks, rules for JSON events, and expectation suites."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.errors import ToolkitError
from rowloom.functions.columns import as_list, col, is_missing, is_numeric, present, require, type_of, with_once
from rowloom.functions.json_values import TYPE_CODES, schema_text, type_code

# --- E2: schema check -----------------------------------------------------------------------------


def schema_check(
    df: DataFrame,
    required: Sequence[str] = (),
    dtypes: Mapping[str, str] | None = None,
    non_null: Sequence[str] = (),
) -> DataFrame:
    """One row per check: ``check, column, expected, actual, violations, passed``.

    Presence and types come from the schema alone; all missing-value counts share one aggregate.
    ``dtypes`` uses Spark type names such as ``bigint`` or ``array<string>``.
    """
    rows: list[tuple[str, str, str, str | None, Column]] = []
    actual = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    for name in required:
        rows.append(("required", name, "present", "present" if name in actual else "absent", F.lit(int(name not in actual))))
    for name, expected in (dtypes or {}).items():
        found = actual.get(name)
        rows.append(("dtype", name, expected, found, F.lit(int(found != expected))))
    counted = [n for n in non_null if n in actual]
    counts = df.agg(*[F.count_if(is_missing(df, n)).alias(f"m{i}") for i, n in enumerate(counted)]) if counted else None
    for name in non_null:
        if name in actual:
            rows.append(("non_null", name, "no missing values", actual[name], col(f"m{counted.index(name)}")))
        else:
            rows.append(("non_null", name, "no missing values", None, F.lit(1)))
    if not rows:
        raise ToolkitError("nothing to check: give required, dtypes or non_null")
    cells = [
        F.struct(
            F.lit(check).alias("check"),
            F.lit(name).alias("column"),
            F.lit(expected).alias("expected"),
            F.lit(found).cast("string").alias("actual"),
            violations.cast("bigint").alias("violations"),
        )
        for check, name, expected, found, violations in rows
    ]
    source = counts if counts is not None else df.sparkSession.range(1)
    return source.select(F.inline(F.array(*cells))).withColumn("passed", F.col("violations") == 0)


# --- E4: rules for JSON events --------------------------------------------------------------------

# Stands in a path for every element of an array.
ITEMS = "[]"
_ANNOTATIONS = {"$schema", "$id", "title", "description", "default", "examples", "format", "$comment"}


@dataclass(frozen=True)
class Rule:
    """One requirement on the value at a path of a JSON event: field names from the root, ``ITEMS`` for each array element."""

    path: tuple[str, ...]
    kind: str
    value: Any

    @property
    def label(self) -> str:
        return self.kind if self.kind != "type" else f"type:{'|'.join(as_list(self.value))}"

    @property
    def text_path(self) -> str:
        return ".".join(self.path).replace(f".{ITEMS}", ITEMS)


def rules_from_schema(schema: Mapping[str, Any], path: tuple[str, ...] = ()) -> list[Rule]:
    """The rules of a JSON Schema made of the keywords below; a nested schema is one of properties or of array items.

    type, properties, required, enum, const, bounds, pattern, lengths, items (one schema for all elements), minItems,
    maxItems, uniqueItems, and additionalProperties as true or false. Other keywords are refused, so that no requirement
    is silently left out.
    """
    rules: list[Rule] = []
    for keyword, value in schema.items():
        if keyword in _ANNOTATIONS:
            continue
        if keyword == "properties":
            for name, sub in value.items():
                rules += rules_from_schema(sub, (*path, name))
        elif keyword == "required":
            rules += [Rule((*path, name), "required", True) for name in value]
        elif keyword == "items" and isinstance(value, Mapping):
            rules += rules_from_schema(value, (*path, ITEMS))
        elif keyword == "additionalProperties" and isinstance(value, bool):
            if not value:
                rules.append(Rule(path, keyword, tuple(schema.get("properties", {}))))
        elif keyword == "uniqueItems" and isinstance(value, bool):
            if value:
                rules.append(Rule(path, keyword, True))
        elif keyword in _RULES and keyword not in ("additionalProperties", "uniqueItems"):
            rules.append(Rule(path, keyword, value))
        else:
            raise ToolkitError(f"unsupported schema keyword {keyword!r} at {'.'.join(path) or 'the root'}")
    return rules


def variant_path(path: Sequence[str]) -> str:
    """A variant path from field names."""
    for name in path:
        if '"' in name or "\\" in name:
            raise ToolkitError(f"field name {name!r} cannot be used in a path")
    return "$" + "".join(f'["{name}"]' for name in path)


def _at(variant: Column, path: Sequence[str], target: str = "variant") -> Column:
    return F.try_variant_get(variant, variant_path(path), target)


@dataclass(frozen=True)
class _Value:
    """Columns with the facts about the value at one path, each computed once per row."""

    type: Column
    number: Column
    string: Column
    boolean: Column
    items: Column
    keys: Column


def _facts(value: Column, code: Column) -> dict[str, Column]:
    """What rules ask of a value besides its type; elements of arrays are variants, keys are names."""

    def typed(test: Column, target: str) -> Column:
        return F.when(test, F.try_variant_get(value, "$", target))

    return {
        "number": typed(code >= TYPE_CODES["number"], "double"),
        "string": typed(code == TYPE_CODES["string"], "string"),
        "boolean": typed(code == TYPE_CODES["boolean"], "boolean"),
        "items": typed(code == TYPE_CODES["array"], "array<variant>"),
        "keys": F.map_keys(typed(code == TYPE_CODES["object"], "map<string,variant>")),
    }


# The facts that a rule needs; rules not listed need the scalar ones.
_SCALAR = ("number", "string", "boolean")
_NEEDS = {
    "type": (), "required": (), "minItems": ("items",), "maxItems": ("items",), "uniqueItems": ("items",),
    "additionalProperties": ("keys",),
}


def _type_rule(v: _Value, wanted: Any) -> Column:
    names = as_list(wanted)
    unknown = [n for n in names if n not in TYPE_CODES]
    if unknown:
        raise ToolkitError(f"unknown JSON types {unknown}")
    allowed = set(names) | ({"integer"} if "number" in names else set())
    return ~v.type.isin(sorted(TYPE_CODES[n] for n in allowed))


def _enum_rule(v: _Value, allowed: Sequence[Any]) -> Column:
    numbers = [float(x) for x in allowed if isinstance(x, (int, float)) and not isinstance(x, bool)]
    strings = [x for x in allowed if isinstance(x, str)]
    flags = [x for x in allowed if isinstance(x, bool)]
    if any(x is not None and not isinstance(x, (bool, int, float, str)) for x in allowed):
        raise ToolkitError("enum values must be scalars")
    tests = [F.coalesce(c.isin(xs), F.lit(False)) for c, xs in ((v.number, numbers), (v.string, strings), (v.boolean, flags)) if xs]
    if any(x is None for x in allowed):
        tests.append(v.type == TYPE_CODES["null"])
    return ~reduce(lambda a, b: a | b, tests, F.lit(False))


def _same_text(element: Column) -> Column:
    """A text that two elements share if they are equal: objects print with sorted keys, numbers as doubles."""
    number = F.try_variant_get(element, "$", "double")
    is_text = F.substring(F.schema_of_variant(element), 1, 2).isin("ST", "BO", "OB", "AR")
    # the number first: it is null for nested elements, whose schemas then need not be spelled out
    return F.when(number.isNotNull() & ~is_text, number.cast("string")).otherwise(F.coalesce(F.to_json(element), F.lit("null")))


# Each entry gives the condition under which a present value breaks the rule.
_RULES: dict[str, Callable[[_Value, Any], Column]] = {
    "type": _type_rule,
    "enum": _enum_rule,
    "const": lambda v, x: _enum_rule(v, [x]),
    "minimum": lambda v, x: v.number < F.lit(float(x)),
    "maximum": lambda v, x: v.number > F.lit(float(x)),
    "exclusiveMinimum": lambda v, x: v.number <= F.lit(float(x)),
    "exclusiveMaximum": lambda v, x: v.number >= F.lit(float(x)),
    "pattern": lambda v, x: ~v.string.rlike(x),
    "minLength": lambda v, x: F.length(v.string) < F.lit(int(x)),
    "maxLength": lambda v, x: F.length(v.string) > F.lit(int(x)),
    "minItems": lambda v, x: F.size(v.items) < F.lit(int(x)),
    "maxItems": lambda v, x: F.size(v.items) > F.lit(int(x)),
    "uniqueItems": lambda v, x: F.size(F.array_distinct(F.transform(v.items, _same_text))) < F.size(v.items),
    "additionalProperties": lambda v, x: F.exists(v.keys, lambda k: ~k.isin(list(x)) if x else F.lit(True)),
}
_MASK_BITS = 60


def _broken(rule: Rule, values: Mapping[tuple[str, ...], _Value]) -> Column:
    value = values[rule.path]
    if rule.kind == "required":
        # a field is only required inside an object that is there
        broken = (values[rule.path[:-1]].type == TYPE_CODES["object"]) & value.type.isNull()
    elif rule.kind in _RULES:
        broken = value.type.isNotNull() & _RULES[rule.kind](value, rule.value)
    else:
        raise ToolkitError(f"unknown rule {rule.kind!r}")
    return F.coalesce(broken, F.lit(False))


_ERRORS = "array<struct<path:string,rule:string>>"


def _child(value: Column, name: str) -> Column:
    return F.try_variant_get(value, variant_path((name,)), "variant")


def _errors_within(value: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The (path, rule) pairs that a value breaks, for rules whose paths start at it; elements have their index in the path.

    Lambdas over arrays of one bind each value and its type, which are used many times but looked up once.
    """
    own = [r for r in rules if not r.path]
    required = [r for r in rules if len(r.path) == 1 and r.kind == "required"]
    nested: dict[str, list[Rule]] = {}
    for r in rules:
        if r.path and r not in required:
            nested.setdefault(r.path[0], []).append(Rule(r.path[1:], r.kind, r.value))

    def found(bound: Column) -> Column:
        v, code = bound["v"], bound["code"]
        values = {(): _Value(code, **_facts(v, code))}
        is_object = code == TYPE_CODES["object"]
        marks = [F.when(_broken(r, values), F.struct(path.alias("path"), F.lit(r.label).alias("rule"))) for r in own]
        for r in required:
            absent = is_object & _child(v, r.path[0]).isNull()
            below = F.concat(path, F.lit(f".{r.path[0]}"))
            marks.append(F.when(absent, F.struct(below.alias("path"), F.lit(r.label).alias("rule"))))
        parts = [F.filter(F.array(*marks), lambda e: e.isNotNull())] if marks else []
        for name, below in nested.items():
            if name == ITEMS:
                parts.append(_array_errors(values[()].items, path, below))
            else:
                inner = _errors_within(_child(v, name), F.concat(path, F.lit(f".{name}")), below)
                parts.append(F.when(is_object, inner).otherwise(F.array().cast(_ERRORS)))
        return F.concat(*parts) if parts else F.array().cast(_ERRORS)

    return _bound(value, found, [name for name in (*(r.path[0] for r in required), *nested)][:1])


def _array_errors(items: Column, path: Column, rules: Sequence[Rule]) -> Column:
    def element(value: Column, index: Column) -> Column:
        # an element that is null is there all the same
        there = F.coalesce(value, F.parse_json(F.lit("null")))
        return _errors_within(there, F.concat(path, F.lit("["), index.cast("string"), F.lit("]")), rules)

    return F.coalesce(F.flatten(F.transform(items, element)), F.array().cast(_ERRORS))


def _kind_text(value: Column, schema: Column, inside: Sequence[str]) -> Column:
    """The schema of a value; only its kind where it is nested and has one of the names inside, or an element."""
    for name in inside:
        if name == ITEMS:
            schema = F.when(F.try_variant_get(value, "$[0]", "variant").isNotNull(), "ARRAY").otherwise(schema)
        else:
            schema = F.when(_child(value, name).isNotNull(), "OBJECT").otherwise(schema)
    return schema


def _bound(value: Column, use: Callable[[Column], Column], inside: Sequence[str] = ()) -> Column:
    def described(v: Column) -> Column:
        return F.struct(v.alias("v"), _kind_text(v, F.schema_of_variant(v), inside).alias("schema"))

    schemas = F.transform(F.array(value), described)
    named = F.transform(schemas, lambda s: F.struct(s["v"].alias("v"), type_code(s["v"], s["schema"]).alias("code")))
    return F.transform(named, use)[0]


def validate_events(df: DataFrame, column: str, rules: Sequence[Rule] | Mapping[str, Any]) -> DataFrame:
    """Adds ``valid`` and ``errors``, an array of (path, rule), to each JSON event.

    ``rules`` is a list of :class:`Rule` or a JSON Schema. Text that is not JSON breaks the rule
    ``json``. The same code runs in batch and on a stream. A rule below an array's items is tested on
    every element, and its error names the element, as in ``lines[2].price``.

    The text is parsed once per row, each path looked up once, and the broken rules of a row are
    bits of a number: the steps stay small enough for the JVM to compile, and only rows with
    errors pay for building the list.
    """
    require(df, column)
    if isinstance(rules, Mapping):
        rules = rules_from_schema(rules)
    event = F.col("__event")
    below = [r for r in rules if ITEMS in r.path]
    rules = [r for r in rules if ITEMS not in r.path]
    arrays: dict[tuple[str, ...], list[Rule]] = {}
    for r in below:
        at = r.path.index(ITEMS)
        arrays.setdefault(r.path[:at], []).append(Rule(r.path[at + 1 :], r.kind, r.value))

    paths = list(dict.fromkeys(p for r in rules for p in ((r.path[:-1], r.path) if r.kind == "required" else (r.path,))))
    paths += [p for p in arrays if p not in paths]
    steps: list[dict[str, Column]] = [{}, {}, {}, {}, {}]
    values: dict[tuple[str, ...], _Value] = {}
    for i, path in enumerate(paths):
        v, s, t = (F.col(f"__{x}{i}") for x in "vst")
        steps[0][f"__v{i}"] = _at(event, path) if path else event
        schema = schema_text(v, None if path else col(column))
        steps[1][f"__s{i}"] = _kind_text(v, schema, [ITEMS]) if path and path in arrays else schema
        steps[2][f"__t{i}"] = type_code(v, s)
        needed = {n for r in rules if r.path == path for n in _NEEDS.get(r.kind, _SCALAR)} | ({"items"} if path in arrays else set())
        steps[3].update({f"__{name}{i}": fact for name, fact in _facts(v, t).items() if name in needed})
        values[path] = _Value(t, **{name: F.col(f"__{name}{i}") for name in (*_SCALAR, "items", "keys")})
    for i, (path, own) in enumerate(arrays.items()):
        steps[4][f"__a{i}"] = _array_errors(values[path].items, F.lit(".".join(path)), own)

    chunks = [rules[i : i + _MASK_BITS] for i in range(0, len(rules), _MASK_BITS)] or [[]]
    masks = {}
    for i, chunk in enumerate(chunks):
        bits = [F.when(_broken(r, values), F.lit(1 << k)).otherwise(F.lit(0)).cast("bigint") for k, r in enumerate(chunk)]
        masks[f"__m{i}"] = reduce(lambda a, b: a.bitwiseOR(b), bits, F.lit(0).cast("bigint"))
    # text that cannot be parsed has no typed value, so none of its bits is set; it gets a mark of its own
    masks["__m0"] = F.when(event.isNull(), F.lit(-1)).otherwise(masks["__m0"])

    checked = df.withColumn("__event", F.try_parse_json(col(column)))
    for step in steps:
        checked = checked.withColumns(step)
    checked = with_once(checked, "__masks", F.array(*masks.values())).withColumns(
        {name: F.col("__masks")[i] for i, name in enumerate(masks)}
    )

    bad_json = F.array(F.struct(F.lit("").alias("path"), F.lit("json").alias("rule")))
    none = F.array().cast(_ERRORS)
    lists = []
    for i, chunk in enumerate(chunks):
        labels = [F.struct(F.lit(r.text_path).alias("path"), F.lit(r.label).alias("rule")) for r in chunk]
        mask = F.col(f"__m{i}")
        if labels:
            lists.append(F.when(mask == 0, none).otherwise(F.filter(F.array(*labels), lambda _, k: F.getbit(mask, k) == 1)))
    lists += [F.col(f"__a{i}") for i in range(len(arrays))]
    errors = F.concat(*lists) if lists else none
    clean = reduce(lambda a, b: a & b, [F.col(m) == 0 for m in masks] + [F.size(f"__a{i}") == 0 for i in range(len(arrays))])
    added = ["__event", "__masks", *masks, *[name for step in steps for name in step]]
    return (
        checked.withColumn("errors", F.when(F.col("__m0") == -1, bad_json).otherwise(errors)).withColumn("valid", clean).drop(*added)
    )


def summarize_errors(validated: DataFrame) -> DataFrame:
    """(path, rule, n): how many events broke each rule.

    ``explode_outer``, because Spark would add a filter on the array to a plain ``explode`` and
    push it below the projection that computes the array, which then runs twice.
    """
    return (
        validated.select(F.explode_outer("errors").alias("e"))
        .filter(F.col("e").isNotNull())
        .groupBy(F.col("e.path").alias("path"), F.col("e.rule").alias("rule"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


# --- E5: expectations -----------------------------------------------------------------------------

_PREFIX = "expect_"


def _between(value: Column, low: Any, high: Any) -> Column:
    """Whether a measured value lies between optional inclusive bounds."""
    tests = [value >= F.lit(low)] if low is not None else []
    tests += [value <= F.lit(high)] if high is not None else []
    return reduce(lambda a, b: a & b, tests, F.lit(True))


class _Plan:
    """Collects the aggregates of a suite so that one job computes all of them."""

    def __init__(self, df: DataFrame):
        self.df = df
        self.aggregates: dict[str, Column] = {}
        self.keys: list[tuple[str, ...]] = []
        self.distinct: list[str] = []

    def measure(self, aggregate: Column) -> Column:
        name = f"m{len(self.aggregates)}"
        self.aggregates[name] = aggregate
        return F.col(name)

    def repeated_rows(self, columns: Sequence[str]) -> Column:
        """Rows whose key occurs more than once; rows with a missing part are left out."""
        key = tuple(columns)
        if key not in self.keys:
            self.keys.append(key)
        return F.col(f"u{self.keys.index(key)}")

    def distinct_values(self, column: str) -> Column:
        """Distinct present values; counted apart, as Spark would regroup all other aggregates by them."""
        if column not in self.distinct:
            self.distinct.append(column)
        return F.col(f"d{self.distinct.index(column)}")

    def run(self) -> DataFrame:
        rows = F.count(F.lit(1)).alias("rows")
        result = self.df.agg(rows, *[a.alias(n) for n, a in self.aggregates.items()])
        for i, key in enumerate(self.keys):
            complete = self.df
            for name in key:
                complete = complete.filter(~is_missing(self.df, name))
            copies = complete.groupBy(*[col(k) for k in key]).agg(F.count(F.lit(1)).alias("n"))
            total = copies.agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("total"))
            result = result.withColumn(f"u{i}", total.scalar())
        for i, name in enumerate(self.distinct):
            values = self.df.select(F.count_distinct(present(self.df, name)).alias("n"))
            result = result.withColumn(f"d{i}", values.scalar())
        return result


def _row_level(plan: _Plan, kwargs: Mapping[str, Any], broken: Column) -> tuple[Column, Column]:
    """(success, unexpected) of a test on the present values, with an optional ``mostly`` share."""
    name = require(plan.df, kwargs["column"])[0]
    unexpected = plan.measure(F.count_if(broken & ~is_missing(plan.df, name)))
    considered = plan.measure(F.count(present(plan.df, name)))
    mostly = float(kwargs.get("mostly", 1.0))
    return unexpected <= (F.lit(1.0) - F.lit(mostly)) * considered + F.lit(1e-9), unexpected


def _expectation(plan: _Plan, kind: str, kw: Mapping[str, Any]) -> tuple[Column, Column, Column]:
    """(success, observed value, unexpected rows) as expressions over the suite's aggregates."""
    df = plan.df
    nothing = F.lit(None)

    def named() -> str:
        return require(df, kw["column"])[0]

    def bounds(value: Column) -> Column:
        return _between(value, kw.get("min_value"), kw.get("max_value"))

    if kind == "expect_table_row_count_to_be_between":
        return bounds(F.col("rows")), F.col("rows"), nothing
    if kind == "expect_table_row_count_to_equal":
        return F.col("rows") == F.lit(kw["value"]), F.col("rows"), nothing
    if kind == "expect_table_column_count_to_equal":
        return F.lit(len(df.columns) == kw["value"]), F.lit(len(df.columns)), nothing
    if kind == "expect_column_to_exist":
        return F.lit(kw["column"] in df.columns), nothing, nothing
    if kind == "expect_column_values_to_not_be_null":
        unexpected = plan.measure(F.count_if(is_missing(df, named())))
        mostly = float(kw.get("mostly", 1.0))
        return unexpected <= (F.lit(1.0) - F.lit(mostly)) * F.col("rows") + F.lit(1e-9), nothing, unexpected
    if kind == "expect_column_values_to_be_null":
        unexpected = plan.measure(F.count(present(df, named())))
        return unexpected == 0, nothing, unexpected
    if kind == "expect_column_values_to_be_unique":
        unexpected = plan.repeated_rows([named()])
        return unexpected == 0, nothing, unexpected
    if kind == "expect_compound_columns_to_be_unique":
        unexpected = plan.repeated_rows(require(df, kw["column_list"]))
        return unexpected == 0, nothing, unexpected
    if kind == "expect_column_values_to_be_in_set":
        success, unexpected = _row_level(plan, kw, ~col(named()).isin([v for v in kw["value_set"] if v is not None]))
        return success, nothing, unexpected
    if kind == "expect_column_values_to_not_be_in_set":
        success, unexpected = _row_level(plan, kw, col(named()).isin([v for v in kw["value_set"] if v is not None]))
        return success, nothing, unexpected
    if kind == "expect_column_values_to_be_between":
        success, unexpected = _row_level(plan, kw, ~bounds(present(df, named())))
        return success, nothing, unexpected
    if kind == "expect_column_values_to_match_regex":
        success, unexpected = _row_level(plan, kw, ~col(named()).cast("string").rlike(kw["regex"]))
        return success, nothing, unexpected
    if kind == "expect_column_value_lengths_to_be_between":
        success, unexpected = _row_level(plan, kw, ~bounds(F.length(col(named()).cast("string"))))
        return success, nothing, unexpected
    if kind == "expect_column_unique_value_count_to_be_between":
        value = plan.distinct_values(named())
        return bounds(value), value, nothing
    statistics = {"min": F.min, "max": F.max, "mean": F.avg, "sum": F.sum, "stdev": F.stddev_samp}
    for name, function in statistics.items():
        if kind == f"expect_column_{name}_to_be_between":
            if name not in ("min", "max") and not is_numeric(type_of(df, named())):
                raise ToolkitError(f"{kind} needs a numeric column")
            value = plan.measure(function(present(df, named())))
            return bounds(value), value, nothing
    raise ToolkitError(f"unknown expectation {kind!r}")


def run_expectations(df: DataFrame, suite: Mapping[str, Any] | Sequence[Mapping[str, Any]]) -> DataFrame:
    """One row per expectation: ``position, expectation_type, column, success, observed, unexpected``.

    ``suite`` is a list of ``{"expectation_type", "kwargs"}`` or a dict holding it under
    ``expectations``. All row-level and aggregate tests share one pass over the table; each
    uniqueness test adds one grouping, reduced before its shuffle.
    """
    items = suite["expectations"] if isinstance(suite, Mapping) else suite
    if not items:
        raise ToolkitError("the suite has no expectations")
    plan = _Plan(df)
    cells = []
    for i, item in enumerate(items):
        kind = item["expectation_type"]
        kwargs = item.get("kwargs", {})
        success, observed, unexpected = _expectation(plan, kind, kwargs)
        target = kwargs.get("column") or ",".join(kwargs.get("column_list", [])) or None
        cells.append(
            F.struct(
                F.lit(i).alias("position"),
                F.lit(kind).alias("expectation_type"),
                F.lit(target).cast("string").alias("column"),
                F.coalesce(success, F.lit(False)).alias("success"),
                observed.cast("string").alias("observed"),
                unexpected.cast("bigint").alias("unexpected"),
            )
        )
    return plan.run().select(F.inline(F.array(*cells)))


def expectation_statistics(results: DataFrame) -> DataFrame:
    """Totals of a suite: evaluated, successful, unsuccessful, percent, overall success."""
    good = F.count_if(F.col("success"))
    total = F.count(F.lit(1))
    return results.agg(
        total.alias("evaluated"),
        good.alias("successful"),
        (total - good).alias("unsuccessful"),
        (F.lit(100.0) * good / total).alias("success_percent"),
        (good == total).alias("success"),
    )
