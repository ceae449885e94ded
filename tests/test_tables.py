"""Selection, joins and aggregation on small literal tables."""

from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from rowloom.errors import ToolkitError, UnknownColumnError
from rowloom.operators import aggregate, joins, select
from rowloom.operators.numbering import first_per_group, number_within

NAN = float("nan")


@pytest.fixture(scope="module")
def ab(spark):
    return spark.createDataFrame([(1, "x"), (2, "y"), (3, "x"), (4, None)], "a int, b string")


def test_filter_equal(ab, rows):
    assert rows(select.filter_rows(ab, [{"column": "b", "op": "==", "value": "x"}]), "a") == [(1,), (3,)]


def test_filter_not_equal_keeps_missing(ab, rows):
    assert rows(select.filter_rows(ab, [{"column": "b", "op": "!=", "value": "x"}]), "a") == [(2,), (4,)]


def test_filter_conditions_are_joined_by_and(ab, rows):
    found = select.filter_rows(ab, [{"column": "b", "op": "==", "value": "x"}, {"column": "a", "op": ">", "value": 1}])
    assert rows(found, "a") == [(3,)]


def test_filter_text_operators_on_numbers(spark, rows):
    df = spark.createDataFrame([(12,), (21,), (123,)], "n int")
    assert rows(select.filter_rows(df, [{"column": "n", "op": "startswith", "value": "12"}])) == [(12,), (123,)]
    assert rows(select.filter_rows(df, [{"column": "n", "op": "endswith", "value": "1"}])) == [(21,)]
    assert rows(select.filter_rows(df, [{"column": "n", "op": "contains", "value": "^.2"}])) == [(12,), (123,)]


def test_filter_contains_literal(spark, rows):
    df = spark.createDataFrame([("a.b",), ("axb",), (None,)], "s string")
    condition = {"column": "s", "op": "contains", "value": "a.b"}
    assert len(rows(select.filter_rows(df, [condition]))) == 2
    assert rows(select.filter_rows(df, [{**condition, "literal": True}])) == [("a.b",)]


def test_filter_nan_is_missing(spark, rows):
    df = spark.createDataFrame([(1.0,), (NAN,), (3.0,)], "v double")
    assert rows(select.filter_rows(df, [{"column": "v", "op": ">", "value": 2.0}])) == [(3.0,)]
    assert select.filter_rows(df, [{"column": "v", "op": "!=", "value": 1.0}]).count() == 2


@pytest.mark.parametrize(
    "condition",
    [
        {"column": "zz", "op": "==", "value": 1},
        {"column": "a", "op": "like", "value": 1},
        {"column": "a", "op": "in", "value": 1},
    ],
)
def test_filter_errors(ab, condition):
    with pytest.raises(ToolkitError):
        select.filter_rows(ab, [condition])


@pytest.mark.parametrize("dtype", ["timestamp", "timestamp_ntz", "string"])
def test_time_range_is_inclusive(spark, dtype):
    df = spark.sql(f"SELECT CAST(t AS {dtype}) AS t FROM VALUES ('2024-01-01 00:00:00'), ('2024-01-02 12:00:00'), ('2024-01-03 00:00:00') v(t)")
    assert select.filter_time_range(df, "t", "2024-01-01", "2024-01-02 12:00:00").count() == 2
    assert select.filter_time_range(df, "t", start=dt.datetime(2024, 1, 2)).count() == 2
    assert select.filter_time_range(df, "t", end=dt.date(2024, 1, 1)).count() == 1
    assert select.filter_time_range(df, "t").count() == 3


def test_time_range_on_dates(spark):
    df = spark.sql("SELECT DATE'2024-01-01' + id AS d FROM range(5)".replace("+ id", "+ CAST(id AS INT)"))
    assert select.filter_time_range(df, "d", "2024-01-02", "2024-01-03 10:00:00").count() == 2
    assert select.filter_time_range(df, "d", "2024-01-02 00:00:01").count() == 3


def test_time_range_errors(spark, ab):
    with pytest.raises(ToolkitError):
        select.filter_time_range(ab, "a", "2024-01-01")
    with pytest.raises(ToolkitError):
        select.filter_time_range(spark.sql("SELECT TIMESTAMP'2024-01-01' AS t"), "t", "soon")
    with pytest.raises(Exception):
        select.filter_time_range(spark.createDataFrame([("soon",)], "t string"), "t", "2024-01-01").collect()


def test_head_tail(ab, rows):
    found = select.head_tail(ab, "a", head=1, tail=2)
    assert rows(found, "section", "a", "total_rows") == [("head", 1, 4), ("tail", 3, 4), ("tail", 4, 4)]
    assert select.head_tail(ab, "a", head=0, tail=None).count() == 0


@pytest.mark.parametrize("partitions", [1, 4, 50])
def test_samples_do_not_depend_on_partitioning(spark, rows, partitions):
    df = spark.range(1000).withColumn("g", F.col("id") % 3)
    base = rows(select.sample_random(df, 20, "id", seed=5))
    assert len(base) == 20
    assert rows(select.sample_random(df.repartition(partitions), 20, "id", seed=5)) == base
    strata = rows(select.sample_stratified(df, "g", 4, "id", seed=5))
    assert len(strata) == 12
    assert rows(select.sample_stratified(df.repartition(partitions), "g", 4, "id", seed=5)) == strata


def test_sample_bounds(ab):
    assert select.sample_random(ab, 100, "a").count() == 4
    assert select.sample_stratified(ab, "b", 1, "a").count() == 3
    with pytest.raises(ToolkitError):
        select.sample_random(ab, -1, "a")


def test_large_strata_samples_go_through_parts(spark, rows):
    df = spark.range(0, 6000, 1, 16).withColumn("g", F.when(F.col("id") < 5000, 0).otherwise(1))
    found = select.sample_stratified(df, "g", 1500, "id")
    assert rows(found.groupBy("g").count()) == [(0, 1500), (1, 1000)]
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "2000")
    try:
        assert rows(select.sample_stratified(df, "g", 1500, "id")) == rows(found)
    finally:
        spark.conf.unset("spark.sql.optimizer.windowGroupLimitThreshold")


LEFT = [(1, "A"), (2, "B"), (None, "N")]
RIGHT = [(1, 100), (3, 300), (None, 0)]


@pytest.mark.parametrize(
    ("how", "null_safe", "expected"),
    [
        ("inner", True, 2),
        ("inner", False, 1),
        ("left", True, 3),
        ("right", True, 3),
        ("outer", True, 4),
        ("outer", False, 5),
    ],
)
def test_join_counts(spark, how, null_safe, expected):
    left, right = spark.createDataFrame(LEFT, "id int, name string"), spark.createDataFrame(RIGHT, "id int, value int")
    assert joins.join(left, right, "id", how, null_safe).count() == expected


def test_join_columns_and_suffixes(spark, rows):
    left, right = spark.createDataFrame([(1, 5)], "id int, v int"), spark.createDataFrame([(1, 6), (2, 7)], "id int, v int")
    found = joins.join(left, right, "id", "outer")
    assert found.columns == ["id", "v_x", "v_y"]
    assert rows(found) == [(1, 5, 6), (2, None, 7)]
    with pytest.raises(ToolkitError):
        joins.join(left, right, "id", "cross")
    with pytest.raises(UnknownColumnError):
        joins.join(left, right, "nope")


def test_outer_join_keeps_copies_of_a_hot_key(spark):
    left = spark.range(3000).select(F.when(F.col("id") < 1000, 0).otherwise(F.col("id")).alias("k"), "id")
    right = spark.createDataFrame([(0, "a"), (0, "b"), (-1, "c"), (-1, "d")], "k bigint, w string")
    assert joins.join(left, right, "k", "outer").count() == 2000 + 2000 + 2


def test_key_presence(spark, rows):
    left, right = spark.createDataFrame(LEFT, "id int, name string"), spark.createDataFrame(RIGHT, "id int, value int")
    assert rows(joins.key_presence(left, right, "id")) == [(1, True, True), (2, True, False), (3, False, True), (None, True, True)]


def test_group_aggregate(spark, rows):
    df = spark.createDataFrame([("A", 10), ("A", 20), ("B", 30), ("B", None), (None, 1)], "g string, v int")
    found = aggregate.group_aggregate(df, "g", {"v": ["count", "size", "sum", "min", "max", "mean", "nunique"]})
    assert found.columns == ["g", "v_count", "v_size", "v_sum", "v_min", "v_max", "v_mean", "v_nunique"]
    assert rows(found) == [("A", 2, 2, 30, 10, 20, 15.0, 2), ("B", 1, 2, 30, 30, 30, 30.0, 1), (None, 1, 1, 1, 1, 1, 1.0, 1)]
    assert aggregate.group_aggregate(df, "g", {"v": "sum"}, drop_null_keys=True).count() == 2
    counted = aggregate.group_aggregate(df, "g", {"v": "nunique"}, distinct_counts_null=True)
    assert rows(counted) == [("A", 2), ("B", 2), (None, 1)]
    with pytest.raises(ToolkitError):
        aggregate.group_aggregate(df, "g", {"v": "median"})


def test_sum_of_only_missing_is_zero(spark, rows):
    df = spark.createDataFrame([("A", NAN), ("A", None)], "g string, v double")
    assert rows(aggregate.group_aggregate(df, "g", {"v": ["sum", "count", "mean"]})) == [("A", 0.0, 0, None)]


def test_count_distinct(spark, rows):
    df = spark.createDataFrame([(1, "x", 1.0), (2, "x", NAN), (2, None, None)], "a int, b string, c double")
    assert rows(aggregate.count_distinct(df)) == [("a", 2), ("b", 1), ("c", 1)]
    assert rows(aggregate.count_distinct(df, "b", approx=True)) == [("b", 1)]
    assert rows(aggregate.count_distinct(df.limit(0))) == [("a", 0), ("b", 0), ("c", 0)]
    with pytest.raises(UnknownColumnError):
        aggregate.count_distinct(df, ["zz"])


def test_count_distinct_of_types(spark, rows):
    df = spark.sql(
        """SELECT DATE'2024-01-01' AS d, TIMESTAMP'2024-01-01' AS t, true AS b, CAST(1.50 AS DECIMAL(5,2)) AS n, array(1) AS l,
                  named_struct('x', 1) AS s, repeat('long', 100) AS w
           UNION ALL SELECT DATE'2024-01-02', NULL, false, 1.5, array(2), named_struct('x', 1), concat(repeat('long', 100), '!')"""
    )
    joined = df.join(df.select("d").distinct(), "d")  # not a plain scan: the other way of reading cells
    expected = [("b", 2), ("d", 2), ("l", 2), ("n", 1), ("s", 1), ("t", 1), ("w", 2)]
    assert rows(aggregate.count_distinct(df)) == expected
    assert rows(aggregate.count_distinct(joined)) == expected


def test_distinct_local_times_in_a_zone_with_summer_time(spark, rows):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Paris")
    try:
        df = spark.sql(
            """SELECT t FROM VALUES (TIMESTAMP_NTZ'2024-03-31 02:30:00'), (TIMESTAMP_NTZ'2024-03-31 03:30:00'),
               (TIMESTAMP_NTZ'2024-03-31 03:30:00.000001'), (TIMESTAMP_NTZ'1901-01-01 00:00:00.5') v(t)"""
        )
        assert rows(aggregate.count_distinct(df)) == [("t", 4)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_describe(spark):
    df = spark.createDataFrame([(1.0, "x"), (2.0, "y"), (3.0, "y"), (NAN, None)], "v double, s string")
    found = {r["column"]: r.asDict() for r in aggregate.describe(df).collect()}
    v, s = found["v"], found["s"]
    assert (v["count"], v["mean"], v["min"], v["p25"], v["p50"], v["p75"], v["max"]) == (3, 2.0, 1.0, 1.5, 2.0, 2.5, 3.0)
    assert math.isclose(v["std"], 1.0)
    assert (s["count"], s["unique"], s["top"], s["freq"], s["dtype"]) == (3, 2, "y", 2, "string")
    approx = aggregate.describe(df, "v", approx=True).first()
    assert approx["p50"] == 2.0


@pytest.mark.parametrize("accuracy", [10, 100, 10_000])
def test_exact_quantiles_match_sorting(spark, accuracy):
    import numpy as np

    rng = np.random.default_rng(3)
    # a third of the rows share one value; the rest is spread unevenly
    values = np.concatenate([np.full(1000, 7.0), rng.exponential(5.0, 1500), rng.normal(0, 1e6, 500)])
    df = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(13)
    found = aggregate.exact_quantiles(df, ["v"], [0.0, 0.01, 0.25, 0.5, 0.9, 1.0], accuracy).collect()
    assert len(found) == 6
    for row in found:
        assert math.isclose(row["value"], float(np.quantile(values, row["q"])), rel_tol=1e-12), row


def test_quantiles_of_one_and_no_value(spark, rows):
    one = spark.createDataFrame([(5.0, None)], "a double, b double")
    assert rows(aggregate.exact_quantiles(one, ["a", "b"], [0.25, 0.5])) == [("a", 0.25, 5.0), ("a", 0.5, 5.0)]
    assert aggregate.describe(one, "b").first()["p50"] is None


def test_value_counts(spark):
    df = spark.createDataFrame([("a",), ("b",), ("b",), ("c",), (None,)], "s string")
    assert [tuple(r) for r in aggregate.value_counts(df, "s", 2).collect()] == [("b", 2), ("a", 1)]


@pytest.mark.parametrize("partitions", [1, 4, 50])
def test_number_within_spreads_a_hot_key(spark, partitions):
    """A third of the rows has one key, another third has no key."""
    df = spark.range(3000).select(
        F.when(F.col("id") < 1000, F.lit("hot")).when(F.col("id") >= 2000, (F.col("id") % 400).cast("string")).alias("k"),
        (F.lit(5000) - F.col("id")).alias("t"),
        "id",
    )
    found = number_within(df.repartition(partitions), ["k"], ["t", "id"]).toPandas()
    assert len(found) == 3000
    for _, group in found.groupby("k", dropna=False):
        ordered = group.sort_values(["t", "id"])
        assert ordered["position"].tolist() == list(range(1, len(group) + 1))
        assert set(ordered["total"]) == {len(group)}


def test_first_per_group(spark, rows):
    df = spark.range(100).withColumn("g", F.col("id") % 2)
    found = first_per_group(df, [F.col("g")], [F.col("id").desc()], 2)
    assert rows(found, "g", "id", "__rank") == [(0, 96, 2), (0, 98, 1), (1, 97, 2), (1, 99, 1)]


def test_number_within_splits_equal_rows(spark):
    """A group of copies is spread over several ranges and still numbered without gaps."""
    df = spark.range(0, 20000, 1, 8).select(F.lit("same").alias("k"), F.lit(1).alias("t"), F.lit("copy").alias("v"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # AQE would merge ranges this small
    try:
        found = number_within(df, ["k"], ["t"])
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    totals = found.agg(F.count_distinct("position"), F.min("position"), F.max("position"), F.max("total")).first()
    assert tuple(totals) == (20000, 1, 20000, 20000)
    written = found.inputFiles()
    assert max(spark.read.parquet(f).count() for f in written) < 5000
