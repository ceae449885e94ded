"""Paths, JSON columns, envelopes, identity of events, payloads."""

from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from rowloom.errors import ToolkitError
from rowloom.functions.columns import python_number_text
from rowloom.operators import events, flatten, json_ops, payload, positions, search
from rowloom.sources.envelope import to_envelope

STORE = {
    "b": {"c": 2, "d e": "x"},
    "sales": [{"product": "Widget A", "quantity": 5}, {"product": "Widget B", "quantity": 10}, {"quantity": 1}],
    "matrix": [[1, 2], [3]],
    "empty": [],
    "zero": 0,
    "no": False,
    "nothing": None,
    "big": 12345678901234567890,
}

# path, expected text (or list for projections)
PATHS = [
    ("b.c", "2"),
    ('b."d e"', "x"),
    ("b", '{"c":2,"d e":"x"}'),
    ("sales[0].product", "Widget A"),
    ("sales[-2].product", "Widget B"),
    ("sales[9]", None),
    ("b[0]", None),
    ("nope.deep", None),
    ("sales[*].product", ["Widget A", "Widget B"]),
    ("sales[?quantity > `5`].product", ["Widget B"]),
    ("sales[?product == 'Widget A'].quantity", ["5"]),
    ("sales[?product != 'Widget A'].quantity", ["10", "1"]),
    ("sales[?quantity >= `1.5`].quantity", ["5", "10"]),
    ("matrix[*][0]", ["1", "3"]),
    ("empty[*].x", []),
    ("b[*]", None),
    ("{p: b.c, q: nope}", '{"p":2,"q":null}'),
    ("sales[0].{name: product}", '{"name":"Widget A"}'),
    ("big", "12345678901234567890"),
]


@pytest.mark.parametrize(("path", "expected"), PATHS)
def test_paths(spark, path, expected):
    df = spark.createDataFrame([(json.dumps(STORE),)], "j string")
    kind = "array<string>" if "[*]" in path or "[?" in path else "string"
    assert json_ops.json_extract(df, "j", {"out": path}, {"out": kind}).first()["out"] == expected


@pytest.mark.parametrize("path", ["", ".a", "a..b", "a[", "a b", "a[*].b[*].c", "a[?x ~ `1`]", "{}", "a[?x == `{`]", "length(a)"])
def test_bad_paths_are_errors(spark, path):
    df = spark.createDataFrame([("{}",)], "j string")
    with pytest.raises(ToolkitError):
        json_ops.json_extract(df, "j", {"out": path})


@pytest.mark.parametrize(
    ("path", "kept"),
    [("b", True), ("empty", False), ("no", False), ("nothing", False), ("zero", True), ("nope", False), ("sales[?quantity > `50`]", False)],
)
def test_truthiness(spark, path, kept):
    df = spark.createDataFrame([(json.dumps(STORE),), ("broken",), (None,)], "j string")
    assert json_ops.filter_by_path(df, "j", path).count() == int(kept)


def test_filter_by_path_compares_types(spark, rows):
    df = spark.createDataFrame([(1, '{"u":1}'), (2, '{"u":"1"}'), (3, '{"u":2}'), (4, "{}"), (5, "bad"), (6, '{"u":1.0}')], "i int, j string")
    assert rows(json_ops.filter_by_path(df, "j", "u", "==", 1), "i") == [(1,), (6,)]
    assert rows(json_ops.filter_by_path(df, "j", "u", "==", "1"), "i") == [(2,)]
    assert rows(json_ops.filter_by_path(df, "j", "u", "!=", 1), "i") == [(2,), (3,), (4,)]
    assert rows(json_ops.filter_by_path(df, "j", "u", "in", [2, "1"]), "i") == [(2,), (3,)]
    assert rows(json_ops.filter_by_path(df, "j", "u", ">", 1), "i") == [(3,)]


def test_group_by_path(spark):
    df = spark.createDataFrame(
        [(0, '{"order_id":1}'), (1, '{"order_id":2}'), (2, '{"order_id":1}'), (3, "{}"), (4, "bad")], "offset int, value string"
    )
    found = {r["group_key"]: (r["n"], [e["offset"] for e in r["examples"]]) for r in json_ops.group_by_path(df, "value", "order_id", "offset").collect()}
    assert found == {"1": (2, [0, 2]), "2": (1, [1])}
    one = json_ops.group_by_path(df, "value", "order_id", "offset", max_groups=1, examples=1).collect()
    assert [(r["group_key"], r["n"], len(r["examples"])) for r in one] == [("1", 2, 1)]


def test_parse_json_column_discovers_fields(spark, rows):
    df = spark.createDataFrame(
        [
            (1, '{"a":1,"o":{"x":"t","deep":{"y":1}},"l":[1,2],"e":[],"id":9}'),
            (2, '{"a":null,"l":[]}'),
            (3, "5"),
            (4, "broken"),
            (5, ""),
            (6, None),
        ],
        "id bigint, j string",
    )
    found = flatten.parse_json_column(df, "j")
    assert sorted(found.columns) == ["a", "e", "id", "l", "o.deep", "o.x"]
    values = {r["a"]: r.asDict() for r in found.collect() if r["a"] is not None}
    assert values[1] == {"a": 1, "e": None, "id": 9, "l": "[1,2]", "o.deep": '{"y":1}', "o.x": "t"}
    assert found.count() == 3
    assert rows(flatten.json_defects(df, "j")) == [(6, 2, 1, 3)]


def test_parse_json_column_with_drifting_types(spark):
    df = spark.createDataFrame([('{"v":1}',), ('{"v":"s"}',), ('{"v":[1]}',), ('{"v":{"k":1}}',), ('{"v":[]}',)], "j string")
    assert sorted((r["v"] for r in flatten.parse_json_column(df, "j").collect()), key=repr) == sorted(["1", "s", "[1]", '{"k":1}', None], key=repr)


def test_parse_json_column_targets(spark):
    df = spark.createDataFrame([('{"a":{"b":"x"},"l":[1],"e":[]}',)], "j string")
    row = flatten.parse_json_column(df, "j", ["a.b", "l", "e", "zz"]).first()
    assert row.asDict() == {"a.b": "x", "l": "[1]", "e": None, "zz": None}
    typed = flatten.parse_json_column(df, "j", schema="l array<int>, a struct<b: string>")
    assert typed.first().asDict() == {"l": "[1]", "a.b": "x"}


def test_parse_json_column_expands_arrays(spark):
    df = spark.createDataFrame(
        [(1, '[{"a":1},"{\\"a\\":2}","bad{",5]'), (2, "[]"), (3, '{"a":3}'), (4, '"text"'), (5, None)], "id int, j string"
    )
    found = flatten.parse_json_column(df, "j", {"a": "bigint"}, expand_arrays=True)
    assert sorted(map(tuple, found.collect()), key=repr) == [(1, 1), (1, 2), (1, None), (3, 3), (4, None)]


def test_flatten_envelope(spark):
    df = spark.createDataFrame(
        [
            (0, 100, 5, "k", '{"a":{"b":{"c":1}},"key":"inner","list":[1],"none":[]}', {"h": "v", "t": "a\nb"}),
            (0, 101, None, None, "plain text", {}),
            (1, 102, 5, "k", "[1, 2]", None),
        ],
        "partition int, offset bigint, timestamp bigint, key string, value string, headers map<string,string>",
    )
    found = flatten.flatten_envelope(df)
    assert found.columns[:4] == ["partition", "offset", "timestamp", "key"]
    assert found.columns[4:] == sorted(found.columns[4:])
    by_offset = {r["offset"]: r for r in found.collect()}
    first = by_offset[100]
    assert (first["a_b_c"], first["list"], first["none"], first["value_key"], first["value"]) == (1, "[1]", None, "inner", None)
    assert (first["header_h"], first["header_t"], first["header_t_base64"]) == ("v", None, "YQpi")
    assert (by_offset[101]["value"], by_offset[101]["timestamp"], by_offset[102]["value"]) == ("plain text", None, "[1,2]")
    given = flatten.flatten_envelope(df, schema="a struct<b: struct<c: int>>", header_names=["h"])
    assert "list" not in given.columns and given.count() == 3


def test_fingerprint_equals_sorted_json(spark):
    values = [0.1, 1e7, 123456789.25, 1e15, 1e16, 1.5e20, 1e-4, 1.234e-4, 1e-5, -0.0, 3.0, 1e22, -2.5e-7, 1.7976931348623157e308]
    texts = ["é\\u00E9 \\\\uABCD 😀 \n\t\x01\x7f/\"", "plain", ""]
    data = [(i, v, texts[i % 3], i % 2 == 0, None if i % 3 else "x") for i, v in enumerate(values)]
    df = spark.createDataFrame(data, "i int, v double, t string, b boolean, n string")
    for row in events.fingerprint(df).collect():
        record = row.asDict()
        digest = record.pop("fingerprint")
        assert digest == hashlib.sha256(json.dumps(record, sort_keys=True).encode()).hexdigest(), record
    nested = spark.sql("SELECT named_struct('z', 1, 'a', array(1.5D, null), 'm', map('k2', 'v', 'k1', 'é')) AS s")
    row = events.fingerprint(nested).first()
    assert row["fingerprint"] == hashlib.sha256(json.dumps({"s": row["s"].asDict(True)}, sort_keys=True).encode()).hexdigest()
    subset = events.fingerprint(df, ["b", "i", "absent"]).filter("i = 0").first()
    assert subset["fingerprint"] == hashlib.sha256(b'{"b": true, "i": 0}').hexdigest()


def test_number_text(spark):
    values = [1.0, 1e-7, 123456.789, 1e100, 12345678.9, -1e16, 9.999e15]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in df.select(python_number_text(F.col("v"))).collect()] == [repr(v) for v in values]


def test_dedupe(spark, rows):
    df = spark.createDataFrame([(0, 1, "a"), (1, 2, "b"), (2, 1, "c"), (3, None, "d")], "at int, id int, value string")
    assert rows(events.dedupe_by_id(df, "at", id_cols="id"), "value") == [("a",), ("b",)]
    assert rows(events.dedupe_by_id(df, ("at", "desc"), id_cols="id"), "value") == [("b",), ("c",)]
    assert rows(events.dedupe_counts(df, id_cols="id")) == [(4, 2, 1)]
    docs = spark.createDataFrame([(0, '{"m":{"b":1,"a":2}}'), (1, '{"m":{"a":2,"b":1}}'), (2, '{"m":null}'), (3, "bad")], "at int, j string")
    assert rows(events.dedupe_by_id(docs, "at", column="j", path="m"), "at") == [(0,)]
    with pytest.raises(ToolkitError):
        events.dedupe_by_id(df, "at")


def test_correlate(spark):
    schema = "user_id int, timestamp bigint, event string"
    batches = [
        spark.createDataFrame([(1, 30, "late"), (None, 1, "no key")], schema),
        spark.createDataFrame([(2, 5, "alone"), (1, None, "no time")], schema),
        spark.createDataFrame([(1, 10, "early")], schema),
    ]
    found = events.correlate(batches, "user_id").orderBy("event_index").collect()
    assert [(r["join_key"], r["event_count"], r["event_index"], r["batch"], r["record"]["event"]) for r in found] == [
        (1, 2, 1, 2, "early"),
        (1, 2, 2, 0, "late"),
    ]
    nested = events.correlate_nested(batches, "user_id", part_size=1).orderBy("part").collect()
    assert [[e["record"]["event"] for e in r["events"]] for r in nested] == [["early"], ["late"]]


def test_correlate_with_one_key_owning_the_events(spark):
    df = spark.range(0, 2000, 1, 7).select(F.lit("hot").alias("k"), (F.col("id") % 50).alias("t"), "id")
    found = events.correlate([df.filter("id < 900"), df.filter("id >= 900")], "k", "t", tie="id").toPandas()
    assert sorted(found["event_index"]) == list(range(1, 2001))
    ordered = found.sort_values("event_index")
    assert list(zip(ordered["event_time"], ordered["batch"])) == sorted(zip(ordered["event_time"], ordered["batch"]))


def test_triage(spark, rows):
    data = [b"", b"\0\0\0\1\5abc", "é text\n".encode(), b"\xff\xfe\x80", b"\1\2\3ab", None, b"\0\0", b"0123456789\1", b"\0\xff\xff\xff\xff"]
    df = spark.createDataFrame([(i, None if d is None else bytearray(d)) for i, d in enumerate(data)], "i int, p binary")
    found = payload.triage_payload(df, "p").orderBy("i").collect()
    assert [r["payload_class"] for r in found] == ["empty", "framed", "text", "binary", "binary", "empty", "binary", "text", "framed"]
    assert (found[1]["schema_id"], bytes(found[1]["payload_body"]), found[3]["payload_text"]) == (261, b"abc", "//6A")
    assert found[8]["schema_id"] == 2**32 - 1
    assert payload.triage_counts(payload.triage_payload(df, "p")).count() == 5
    with pytest.raises(ToolkitError):
        payload.triage_payload(df, "i")


def test_base64(spark):
    df = spark.createDataFrame([("x" * 100,)], "t string")
    encoded = payload.base64_encode(df, "t", "e")
    assert "\n" not in encoded.first()["e"]
    assert bytes(payload.base64_decode(encoded, "e", "d").first()["d"]) == b"x" * 100
    bad = spark.createDataFrame([("!!!",)], "e string")
    assert payload.base64_decode(bad, "e", "d", lenient=True).first()["d"] is None
    with pytest.raises(Exception):
        payload.base64_decode(bad, "e", "d").collect()


def test_envelope_forms(spark):
    raw = spark.createDataFrame(
        [(0, 1, bytearray(b"k\xff"), bytearray(b"v"), [("h", bytearray(b"1")), ("h", bytearray(b"2")), ("i", bytearray(b"3"))])],
        "partition int, offset bigint, key binary, value binary, headers array<struct<key: string, value: binary>>",
    ).withColumn("timestamp", F.expr("TIMESTAMP'2024-01-01 00:00:01'"))
    row = to_envelope(raw).first()
    assert (row["key"], row["value"], row["headers"], row["timestamp"]) == ("k�", "v", {"h": "2", "i": "3"}, 1704067201000)
    text = raw.withColumn("headers", F.lit('{"a":"b"}'))
    assert to_envelope(text).first()["headers"] == {"a": "b"}
    assert to_envelope(raw.drop("headers")).first()["headers"] == {}


@pytest.fixture(scope="module")
def log(spark):
    data = [(p, o) for p, offsets in {0: [5, 6, 9], 1: [0, 1, 2, 3], 2: [7]}.items() for o in offsets]
    return spark.createDataFrame(data, "partition int, offset bigint")


def test_offsets(spark, log, rows):
    assert rows(positions.offset_summary(log)) == [(0, 5, 10, 3, 2), (1, 0, 4, 4, 0), (2, 7, 8, 1, 0)]
    commits = spark.createDataFrame([(0, 6), (1, 4)], "partition int, committed bigint")
    assert rows(positions.offset_summary(log, commits), "partition", "committed", "lag") == [(0, 6, 4), (1, 4, 0), (2, None, 1)]


def test_read_range_and_tail(log, rows):
    assert rows(positions.read_range(log, 1, 2)) == [(1, 2), (1, 3)]
    assert rows(positions.read_range(log, from_offset=6, max_records=2)) == [(0, 6), (0, 9)]
    assert rows(positions.read_tail(log, 6)) == [(0, 6), (0, 9), (1, 2), (1, 3), (2, 7)]
    assert rows(positions.read_tail(log, 1)) == [(0, 9)]
    assert rows(positions.read_tail(log, 3, partition=1)) == [(1, 1), (1, 2), (1, 3)]


def test_search(spark, rows, tmp_path):
    df = spark.createDataFrame([(1, "one\n  two TWO \nthree"), (2, "none")], "id int, t string")
    found = search.search_text(df, "t", "(?i)two|three", "id")
    assert rows(found) == [(1, 2, "two TWO"), (1, 3, "three")]
    assert rows(search.match_counts(found, "id")) == [(1, 2)]
    (tmp_path / "a.txt").write_text("x\n needle \n")
    (tmp_path / "b.log").write_text("needle\n")
    found = search.search_files(spark, str(tmp_path), "need.e", "*.txt").collect()
    assert [(r["line_number"], r["line"]) for r in found] == [(2, "needle")]


def test_line_numbers_of_split_files(spark, tmp_path):
    for name, n in (("a.txt", 5000), ("b.txt", 700)):
        (tmp_path / name).write_text("".join(f"line {i}\n" for i in range(1, n + 1)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        found = search.search_files(spark, str(tmp_path), "7$").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(found) == 570 and all(r["line"] == f"line {r['line_number']}" for r in found)


def test_flattened_names_that_meet(spark):
    df = spark.createDataFrame(
        [
            (0, 1, 1, "k", '{"a_b":1,"header_kind":"mine"}', {"kind": "h"}),
            (0, 2, 1, "k", '{"a":{"b":"text"}}', {"kind": "h"}),
        ],
        "partition int, offset long, timestamp long, key string, value string, headers map<string,string>",
    )
    found = flatten.flatten_envelope(df).orderBy("offset").collect()
    assert [r["a_b"] for r in found] == ["1", "text"]
    assert (found[0]["header_kind"], found[0]["value_header_kind"]) == ("h", "mine")


def test_no_valid_json_is_an_error(spark):
    df = spark.createDataFrame([("{broken",), (None,)], "doc string")
    with pytest.raises(ToolkitError):
        flatten.parse_json_column(df, "doc")


def test_nan_is_no_id(spark):
    df = spark.createDataFrame([(float("nan"), 1), (None, 2), (1.0, 3)], "k double, n int")
    assert [r["n"] for r in events.dedupe_by_id(df, "n", id_cols="k").collect()] == [3]


def test_fingerprint_of_long_backslash_runs(spark):
    import json
    from hashlib import sha256

    texts = ["\\" * n + "É" for n in (0, 1, 2, 150, 250, 451)] + ["a\\u00C9É\n\\É"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    found = {r["i"]: r["fingerprint"] for r in events.fingerprint(df, ["t"]).collect()}
    for i, t in enumerate(texts):
        assert found[i] == sha256(json.dumps({"t": t}, sort_keys=True).encode()).hexdigest()


def test_headers_as_a_map(spark):
    schema = "partition int, offset long, timestamp long, key string, value string, headers map<string,string>"
    data = [(0, 1, 1, "k", '{"a":1,"headers":2}', {"h": "v", "t": "a\nb", "e": ""}), (0, 2, 1, "k", "plain", {}), (0, 3, 1, "k", "[1]", None)]
    data += [(0, 4 + i, 1, "k", "{}", {f"id{i}": "x"}) for i in range(1200)]
    found = flatten.flatten_envelope(spark.createDataFrame(data, schema), headers="map")
    assert found.columns == ["partition", "offset", "timestamp", "key", "a", "headers", "value", "value_headers"]
    rows = {r["offset"]: r for r in found.collect()}
    assert rows[1]["headers"] == {"header_h": "v", "header_t_base64": "YQpi"} and (rows[1]["a"], rows[1]["value_headers"]) == (1, 2)
    assert rows[2]["headers"] == {} and rows[3]["headers"] is None and rows[9]["headers"] == {"header_id5": "x"}
    with pytest.raises(ToolkitError):
        flatten.flatten_envelope(spark.createDataFrame(data, schema), headers="list")


@pytest.mark.parametrize("operator", ["parse_json_column", "flatten_envelope"])
def test_discovery_reads_the_input_once(spark, tmp_path, operator):
    """The input's file may go as soon as the call returns: names and rows come from what was parsed once."""
    path = str(tmp_path / "in")
    spark.createDataFrame(
        [(0, 1, 1, "k", '{"a":1,"b":{"c":[1,2]},"d":"x"}', {"h": "v"}), (0, 2, 1, "k", '{"a":2.5,"d":[]}', {})],
        "partition int, offset long, timestamp long, key string, value string, headers map<string,string>",
    ).write.parquet(path)
    source = spark.read.parquet(path)
    if operator == "parse_json_column":
        found = flatten.parse_json_column(source, "value")
    else:
        found = flatten.flatten_envelope(source)
    assert path not in found._jdf.queryExecution().optimizedPlan().toString() and all(path not in f for f in found.inputFiles())
    assert found.count() == 2 and {"a", "d"} <= set(found.columns)
