"""Comparison, validation, profiles and charts on small literal tables."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from rowloom.errors import ToolkitError
from rowloom.operators import charts, compare, profile, quality
from rowloom.operators.profile import ChartSpec

NAN = float("nan")


def _pair(spark, a, b, schema="id int, val int"):
    return spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)


def test_diff(spark, rows):
    found = compare.diff_tables(*_pair(spark, [(1, 10), (2, 20)], [(1, 11), (3, 30)]), "id")
    assert rows(found.summary) == [(1, 1, 1, 1, 0)]
    (example,) = found.examples.collect()
    assert example["id"] == 1
    assert [tuple(c) for c in example["changes"]] == [("val", "10", "11")]
    assert rows(found.keys, "id", "status") == [(1, "changed"), (2, "only_in_a"), (3, "only_in_b")]


def test_diff_same_and_missing(spark, rows):
    side = [(1, None, NAN), (2, 5, 1.5)]
    found = compare.diff_tables(*_pair(spark, side, side, "id int, val int, x double"), "id")
    assert rows(found.summary) == [(0, 0, 2, 0, 0)]


def test_diff_count_is_exact_beyond_the_examples(spark, rows):
    a, b = _pair(spark, [(i, 10) for i in range(100)], [(i, 20) for i in range(100)])
    found = compare.diff_tables(a, b, "id", max_changed=10)
    assert found.examples.count() == 10
    assert rows(found.summary) == [(0, 0, 100, 100, 0)]


def _not_same(found):
    return sorted((tuple(r) for r in found.keys.where("status <> 'same'").collect()), key=repr)


@pytest.mark.parametrize("buckets", [1, 7, compare.BUCKETS])
def test_diff_by_checksum_gives_the_same_answer(spark, buckets):
    schema = "k int, j string, x double, s string, t string, l array<int>, m map<string,int>"
    base = [(i, None if i % 7 == 0 else f"j{i}", i / 3, None, f"t{i % 5}", [i, None], {"a": i}) for i in range(400)]
    base += [(None, None, 0.0, "a", None, None, None), (None, "q", float("nan"), "", "", [], {})]
    other = [(r[0], r[1], -0.0 if r[2] == 0 else r[2], *r[3:]) for r in base]
    for i, change in enumerate(({3: "x"}, {3: "t5", 4: None}, {5: [1]}, {6: {"a": 1}}, {2: None}, {2: float("nan")}, {1: "new"}, {0: 9000})):
        row = list(other[20 + i])
        for at, value in change.items():
            row[at] = value
        other[20 + i] = tuple(row)
    # a value that moves to the next column
    other[50] = (*other[50][:3], other[50][4], other[50][3], *other[50][5:])
    other = other[:-5] + [(5000, "only", 1.0, None, None, None, None), other[60], (7001, "twice", 1.0, *[None] * 4), (7001, "twice", 2.0, *[None] * 4)]
    a, b = spark.createDataFrame(base, schema), spark.createDataFrame(other, schema.replace("k int", "k bigint"))
    plain, quick = compare.diff_tables(a, b, ["k", "j"]), compare.diff_by_checksum(a, b, ["k", "j"], buckets=buckets)
    assert _not_same(quick) == _not_same(plain) and quick.keys.where("status = 'same'").isEmpty()
    assert quick.summary.collect() == plain.summary.collect() and quick.examples.collect() == plain.examples.collect()
    for x, y in ((a.limit(0), b), (a, b.limit(0)), (a.limit(0), b.limit(0)), (a, a)):
        plain, quick = compare.diff_tables(x, y, ["k", "j"], ["x"]), compare.diff_by_checksum(x, y, ["k", "j"], ["x"], buckets=buckets)
        assert _not_same(quick) == _not_same(plain) and quick.summary.collect() == plain.summary.collect()


def test_diff_by_checksum_counts_rows_of_alike_repeated_keys(spark):
    a = spark.createDataFrame([(1, 2), (1, 2), (3, 4)], "k int, v int")
    assert tuple(compare.diff_by_checksum(a, a, "k").summary.first()) == (0, 0, 3, 0, 0)
    assert tuple(compare.diff_by_checksum(a, a.limit(0), "k").summary.first()) == tuple(compare.diff_tables(a, a.limit(0), "k").summary.first())
    with pytest.raises(ToolkitError):
        compare.diff_by_checksum(a, a, "k", buckets=0)


def test_diff_duplicates_and_null_keys(spark, rows):
    a, b = _pair(spark, [(1, 1), (1, 2), (None, 5)], [(1, 1), (None, 6)])
    found = compare.diff_tables(a, b, "id")
    assert rows(found.keys, "id", "status") == [(1, "duplicate"), (None, "changed")]
    with pytest.raises(ToolkitError):
        compare.diff_tables(a, b, "id", ["id"])


def test_reconcile(spark, rows):
    left, right = _pair(spark, [(1, 1), (2, 1), (3, 1), (3, 2)], [(1, 1), (2, 1), (4, 1), (None, 1)])
    found = compare.reconcile_counts(left, right, "id", max_examples=2)
    assert rows(found.counts) == [(1, 1, 1, 0), (2, 1, 1, 0), (3, 2, 0, 2), (4, 0, 1, -1), (None, 0, 1, -1)]
    assert rows(found.summary) == [(4, 4, 3, 4, 2, 3)]
    assert found.examples.first()["id"] == 3


def test_schema_check(spark):
    df = spark.createDataFrame([(1, "x"), (None, "y"), (3, None)], "a int, b string")
    found = quality.schema_check(df, ["a", "c"], {"a": "int", "b": "int"}, ["a", "b"]).collect()
    state = {(r["check"], r["column"]): (r["violations"], r["passed"]) for r in found}
    assert state == {
        ("required", "a"): (0, True),
        ("required", "c"): (1, False),
        ("dtype", "a"): (0, True),
        ("dtype", "b"): (1, False),
        ("non_null", "a"): (1, False),
        ("non_null", "b"): (1, False),
    }


PERSON = {"type": "object", "required": ["name"], "properties": {"name": {"type": "string"}, "age": {"type": "integer"}}}


def _validate(spark, schema, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, j string")
    found = quality.validate_events(df, "j", schema).orderBy("i").collect()
    assert all(r["valid"] == (not r["errors"]) for r in found)
    return [[f"{e['path']}:{e['rule']}" for e in r["errors"]] for r in found]


def test_validate_person(spark):
    found = _validate(
        spark, PERSON, '{"name":"A","age":30}', '{"name":"A","age":"x"}', '{"age":2.0}', "[1]", "broken", None, '{"name":null,"age":2.5}'
    )
    assert found == [
        [],
        ["age:type:integer"],
        ["name:required"],
        [":type:object"],
        [":json"],
        [":json"],
        ["name:type:string", "age:type:integer"],
    ]


def test_validate_all_rules(spark):
    schema = {
        "properties": {
            "e": {"enum": ["a", 1, None, True]},
            "n": {"minimum": 1, "maximum": 5},
            "x": {"exclusiveMinimum": 1, "exclusiveMaximum": 5},
            "s": {"pattern": "^a+$", "minLength": 2, "maxLength": 3},
            "o": {"required": ["p"], "properties": {"p": {"type": ["string", "null"]}}},
        }
    }
    good = '{"e":"a","n":1,"x":1.5,"s":"aa","o":{"p":null}}'
    assert _validate(spark, schema, good, '{"e":1.0}', '{"e":null}', '{"e":true}', "{}", '{"n":"text","o":5}') == [[]] * 6
    bad = '{"e":false,"n":0,"x":5,"s":"b","o":{"p":1}}'
    assert sorted(_validate(spark, schema, bad)[0]) == [
        "e:enum",
        "n:minimum",
        "o.p:type:string|null",
        "s:minLength",
        "s:pattern",
        "x:exclusiveMaximum",
    ]
    assert _validate(spark, schema, '{"n":6,"s":"aaaa","o":{}}') == [["n:maximum", "s:maxLength", "o.p:required"]]


def test_validate_with_many_rules(spark):
    schema = {"properties": {f"f{i}": {"type": "integer", "minimum": 0} for i in range(50)}}
    text = json.dumps({f"f{i}": (-1 if i % 10 == 0 else i) for i in range(50)})
    assert _validate(spark, schema, text) == [[f"f{i}:minimum" for i in range(0, 50, 10)]]


NESTED = {
    "type": "object",
    "required": ["lines"],
    "additionalProperties": False,
    "properties": {
        "id": {"type": "integer"},
        "lines": {
            "type": "array",
            "minItems": 1,
            "maxItems": 3,
            "uniqueItems": True,
            "items": {
                "type": "object",
                "required": ["n"],
                "additionalProperties": False,
                "properties": {
                    "n": {"type": "integer", "minimum": 1},
                    "tags": {"type": "array", "items": {"type": "string", "maxLength": 2}},
                    "o": {"type": "object", "required": ["x"], "properties": {"x": {"enum": [1, None]}}},
                    "grid": {"items": {"items": {"type": "integer"}, "minItems": 2}},
                },
            },
        },
    },
}


@pytest.mark.parametrize(
    ("text", "errors"),
    [
        ('{"id":1,"lines":[{"n":1},{"n":2,"tags":[]}]}', []),
        ('{"lines":[{"n":1,"tags":["a","bbb",3,null]}]}', ["lines[0].tags[1]:maxLength", "lines[0].tags[2]:type:string", "lines[0].tags[3]:type:string"]),
        ('{"lines":[]}', ["lines:minItems"]),
        ('{"lines":{},"z":1}', [":additionalProperties", "lines:type:array"]),
        ("{}", ["lines:required"]),
        ("[]", [":type:object"]),
        ("null", [":type:object"]),
        ("x", [":json"]),
        ('{"lines":[{"n":1},null,5,6]}', ["lines:maxItems", "lines[1]:type:object", "lines[2]:type:object", "lines[3]:type:object"]),
        ('{"lines":[null,null]}', ["lines:uniqueItems", "lines[0]:type:object", "lines[1]:type:object"]),
        ('{"lines":[{"n":1,"tags":["a"]},{"tags":["a"],"n":1.0}]}', ["lines:uniqueItems"]),
        ('{"lines":[{"n":0,"q":1,"o":{}},{"o":{"x":null}},{"n":2,"o":{"x":2}}]}',
         ["lines[0]:additionalProperties", "lines[0].n:minimum", "lines[0].o.x:required", "lines[1].n:required", "lines[2].o.x:enum"]),
        ('{"lines":[{"n":1,"grid":[[1,2],[1],[1,"a"],3]}]}', ["lines[0].grid[1]:minItems", "lines[0].grid[2][1]:type:integer"]),
    ],
)
def test_validate_arrays_and_closed_objects(spark, text, errors):
    row = quality.validate_events(spark.createDataFrame([(text,)], "j string"), "j", NESTED).first()
    assert sorted(f"{e['path']}:{e['rule']}" for e in row["errors"]) == sorted(errors) and row["valid"] == (not errors)


def test_unique_items_compare_by_value(spark):
    df = spark.createDataFrame([('{"a":[1,1.0]}',), ('{"a":[1,"1",true,"true",null,"null"]}',), ('{"a":[{"x":1,"y":2},{"y":2,"x":1}]}',)], "j string")
    found = quality.validate_events(df, "j", {"properties": {"a": {"uniqueItems": True}}}).collect()
    assert [r["valid"] for r in found] == [False, True, False]


def test_kinds_of_nested_values_need_no_schema(spark):
    texts = ["[]", "[null]", "[1]", "[[1]]", "{}", '{"k": null}', '{"k": 1}', '{"j": [1]}', "null", "1", "2.0", '"k"', "true", None]
    v = F.try_parse_json("text")
    schema = F.schema_of_variant(v)
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    kinds = [quality._kind_text(v, schema, inside) for inside in ([quality.ITEMS], ["k"])]
    found = df.select("text", *[F.substring(c, 1, 2) for c in (schema, *kinds)]).collect()
    assert all(r[1] == r[2] == r[3] for r in found)
    # a schema that is not spelled out for the nested
    quick = df.select("text", *[quality._kind_text(v, F.lit("none"), inside) for inside in ([quality.ITEMS], ["k"])]).collect()
    assert [r[0] for r in quick if r[1] == "ARRAY"][-2:] == ["[1]", "[[1]]"] and '{"k": 1}' in [r[0] for r in quick if r[2] == "OBJECT"]


def test_open_objects_and_whole_arrays(spark):
    df = spark.createDataFrame([('[{"a":1},{"a":"x"}]',), (None,)], "j string")
    schema = {"type": "array", "uniqueItems": False, "items": {"additionalProperties": True, "properties": {"a": {"type": "integer"}}}}
    found = quality.validate_events(df, "j", schema).collect()
    assert [[tuple(e) for e in r["errors"]] for r in found] == [[("[1].a", "type:integer")], [("", "json")]]


@pytest.mark.parametrize("schema", [{"items": [{}]}, {"items": True}, {"additionalProperties": {"type": "string"}}, {"prefixItems": []}, {"items": {"oneOf": []}}, {"uniqueItems": 1}])
def test_unsupported_array_keywords_are_refused(schema):
    with pytest.raises(ToolkitError):
        quality.rules_from_schema(schema)


def test_unknown_schema_keyword_is_refused():
    with pytest.raises(ToolkitError):
        quality.rules_from_schema({"oneOf": []})
    with pytest.raises(ToolkitError):
        quality.rules_from_schema({"properties": {"a": {"$ref": "x"}}})


def test_expectations(spark):
    df = spark.createDataFrame([(1, "a", 5.0), (2, "b", NAN), (2, None, 7.0)], "id int, s string, v double")

    def run(kind, **kwargs):
        (row,) = quality.run_expectations(df, {"expectations": [{"expectation_type": kind, "kwargs": kwargs}]}).collect()
        return row["success"], row["observed"], row["unexpected"]

    assert run("expect_table_row_count_to_equal", value=3) == (True, "3", None)
    assert run("expect_table_column_count_to_equal", value=2) == (False, "3", None)
    assert run("expect_column_to_exist", column="zz") == (False, None, None)
    assert run("expect_column_values_to_not_be_null", column="v") == (False, None, 1)
    assert run("expect_column_values_to_not_be_null", column="v", mostly=0.6) == (True, None, 1)
    assert run("expect_column_values_to_be_null", column="s") == (False, None, 2)
    assert run("expect_column_values_to_be_unique", column="id") == (False, None, 2)
    assert run("expect_compound_columns_to_be_unique", column_list=["id", "s"]) == (True, None, 0)
    assert run("expect_column_values_to_be_in_set", column="s", value_set=["a"]) == (False, None, 1)
    assert run("expect_column_values_to_not_be_in_set", column="s", value_set=["z"]) == (True, None, 0)
    assert run("expect_column_values_to_be_between", column="v", min_value=6) == (False, None, 1)
    assert run("expect_column_values_to_match_regex", column="s", regex="[ab]") == (True, None, 0)
    assert run("expect_column_value_lengths_to_be_between", column="s", max_value=1) == (True, None, 0)
    assert run("expect_column_unique_value_count_to_be_between", column="id", max_value=2) == (True, "2", None)
    assert run("expect_column_mean_to_be_between", column="v", min_value=6, max_value=6) == (True, "6.0", None)
    assert run("expect_column_min_to_be_between", column="v", min_value=6) == (False, "5.0", None)
    with pytest.raises(ToolkitError):
        run("expect_magic")


def test_profile_classes(spark):
    df = spark.range(40).select(
        F.timestamp_seconds("id").alias("t"),
        (F.col("id") % 7).alias("n"),
        (F.col("id") > 3).alias("flag"),
        F.concat(F.lit("id"), "id").alias("ident"),
        (F.col("id") % 3).cast("string").alias("cat"),
        F.when(F.col("id") < 8, F.lit("x")).alias("mostly_null"),
        F.encode(F.col("id").cast("string"), "UTF-8").alias("raw"),
    )
    found = {r["column"]: r for r in profile.profile_columns(df).collect()}
    classes = {c: r["class"] for c, r in found.items()}
    assert classes == {
        "t": "datetime",
        "n": "numeric",
        "flag": "numeric",
        "ident": "id",
        "cat": "categorical",
        "mostly_null": "categorical",
        "raw": "id",
    }
    assert (found["mostly_null"]["nulls"], found["mostly_null"]["null_ratio"], found["cat"]["max_repeat"]) == (32, 0.8, 14)


def _suggest(df, hints=None):
    return profile.suggest_chart(profile.profile_columns(df), hints)


def test_suggested_charts(spark):
    days = spark.range(10).select(F.expr("TIMESTAMP'2024-01-01' + make_interval(0,0,0,CAST(id AS INT))").alias("date"), F.col("id").alias("value"))
    assert _suggest(days) == ChartSpec("line", "date", "value")
    bars = spark.createDataFrame([("A", 1), ("B", 2), ("C", 3)], "category string, value int")
    assert _suggest(bars) == ChartSpec("bar", "category", "value")
    counts = spark.createDataFrame([("A", 1, 2), ("B", 2, 3)], "k string, ident int, event_count int")
    assert _suggest(counts).y == "event_count"
    grouped = spark.createDataFrame([("A", "x", 1), ("A", "y", 2)], "k string, g string, v int")
    assert _suggest(grouped).group_by == "g"
    numbers = spark.range(20).select(F.col("id").cast("double").alias("value"))
    assert _suggest(numbers) == ChartSpec("histogram", "value")
    assert _suggest(numbers.withColumn("w", F.col("value"))) == ChartSpec("scatter", "value", "w")
    assert _suggest(spark.createDataFrame([("a",)], "s string")) == ChartSpec("bar", "s")
    hinted = _suggest(bars, {"chart_type": "line", "x": "a", "y": "b", "top_k": 3})
    assert (hinted.chart_type, hinted.x, hinted.top_k) == ("line", "a", 3)


def test_chart_data_of_each_kind(spark, rows):
    df = spark.createDataFrame([("A", "x", 1.0), ("A", "y", 3.0), ("B", "x", 5.0)], "k string, g string, v double")
    assert rows(profile.chart_data(df, ChartSpec("bar", "k", "v"))) == [("A", 2.0), ("B", 5.0)]
    assert rows(profile.chart_data(df, ChartSpec("bar", "k", "v", group_by="g"))) == [("A", "x", 1.0), ("A", "y", 3.0), ("B", "x", 5.0)]
    assert rows(profile.chart_data(df, ChartSpec("bar", "k"))) == [("A", 2), ("B", 1)]
    assert profile.chart_data(df, ChartSpec("scatter", "v", "v")).count() == 3
    assert profile.chart_data(df, ChartSpec("histogram", "v")).count() == 30
    only = ChartSpec("bar", "k", filters=[{"column": "g", "op": "==", "value": "x"}])
    assert rows(profile.chart_data(df, only)) == [("A", 1), ("B", 1)]


def test_bar_of_unique_rows_keeps_the_values(spark, rows):
    df = spark.createDataFrame([("A", 7), ("B", 9)], "k string, v int")
    assert rows(charts.bar_data(df, "k", "v", agg="count")) == [("A", 7), ("B", 9)]
    twice = df.unionByName(df)
    assert rows(charts.bar_data(twice, "k", "v", agg="count", top_k=1)) == [("A", 2)]


def test_pivot_refuses_too_many_series(spark):
    df = spark.range(10).select(F.lit(1).alias("x"), F.col("id").alias("s"), F.lit(1.0).alias("y"))
    with pytest.raises(ToolkitError):
        charts.pivot_data(df, "x", "s", "y", max_series=5)
    assert len(charts.pivot_data(df, "x", "s", "y", values=[0, 1]).columns) == 3


def test_resample_fills_gaps(spark, rows):
    df = spark.sql("SELECT * FROM VALUES (TIMESTAMP_NTZ'2024-01-01 01:00:00', 1.0D), (TIMESTAMP_NTZ'2024-01-03 05:00:00', 3.0D) v(t, x)")
    assert [r["x"] for r in charts.resample(df, "t", "x", "day").orderBy("t").collect()] == [1.0, None, 3.0]
    assert charts.resample(df, "t", "x", "auto").count() == 53


def test_histogram_edges(spark, rows):
    df = spark.createDataFrame([(0.0,), (5.0,), (10.0,), (NAN,), (None,)], "v double")
    assert [r["n"] for r in charts.histogram(df, "v", 2).orderBy("bin").collect()] == [1, 2]
    flat = spark.createDataFrame([(3,), (3,)], "v int")
    assert sum(r["n"] for r in charts.histogram(flat, "v", 4).collect()) == 2
    assert charts.histogram(flat.limit(0), "v").count() == 0


def test_evidence_bundle(spark, tmp_path):
    df = spark.createDataFrame([(1, [1, 2]), (2, None)], "a int, l array<int>")
    written = profile.evidence_bundle(df, str(tmp_path / "bundle"), sample_rows=1)
    record = spark.read.json(written.metadata).first()
    assert (record["rows"], record["columns"], record["dtypes"], len(record["sample"])) == (2, ["a", "l"], ["int", "array<int>"], 1)
    assert spark.read.parquet(written.parquet).count() == 2
    assert spark.read.option("header", True).csv(written.csv).count() == 2


def test_diff_compares_values_not_texts(spark):
    a = spark.sql("SELECT * FROM VALUES (1, 1, 0.0D, 1.0BD, 'x'), (2, 2, 1.5D, 2.50BD, 'y') v(k, n, d, m, s)")
    b = spark.sql("SELECT * FROM VALUES (1, 1.0D, -0.0D, 1.00BD, 'x'), (2, 2.5D, 1.5D, 2.5BD, 'y') v(k, n, d, m, s)")
    found = {r["k"]: (r["status"], [c["column"] for c in r["changes"]]) for r in compare.diff_tables(a, b, "k").keys.collect()}
    assert found == {1: ("same", []), 2: ("changed", ["n"])}


def test_value_set_with_none_still_finds_others(spark):
    df = spark.createDataFrame([("a",), ("z",), (None,)], "v string")
    suite = [{"expectation_type": "expect_column_values_to_be_in_set", "kwargs": {"column": "v", "value_set": ["a", None]}}]
    found = quality.run_expectations(df, suite).collect()
    assert [r["success"] for r in found] == [False]


def test_bars_of_text_and_missing_values(spark, rows):
    df = spark.createDataFrame([("a", "p"), ("b", None)], "x string, y string")
    assert rows(charts.bar_data(df, "x", "y", "count")) == [("a", 1), ("b", 0)]
    df = spark.createDataFrame([("a", 1.0), ("b", None)], "x string, y double")
    assert rows(charts.bar_data(df, "x", "y", "sum")) == [("a", 1.0), ("b", None)]


def test_histogram_leaves_infinities_out(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (float("inf"),)], "v double")
    assert [r["n"] for r in charts.histogram(df, "v", 2).orderBy("bin").collect()] == [1, 1]


def test_hours_over_years(spark):
    df = spark.sql("SELECT * FROM VALUES (TIMESTAMP_NTZ'2000-01-01 01:30:00', 1.0D), (TIMESTAMP_NTZ'2024-01-03 05:00:00', 3.0D) v(t, x)")
    found = charts.resample(df, "t", "x", "hour")
    assert found.count() == 8768 * 24 + 5
    assert found.where("x IS NOT NULL").count() == 2
