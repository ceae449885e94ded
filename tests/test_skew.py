"""Joins with keys that are heavy on both sides, against the plain join."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from rowloom.errors import ToolkitError
from rowloom.operators import joins, skew


def sides(spark):
    """Two heavy keys on both sides, one heavy on each side alone, heavy missing keys, and light ones."""
    key = "CASE WHEN id % 4 = 0 THEN 0 WHEN id % 10 = 1 THEN 1 WHEN id % 10 = {own} THEN {name} WHEN id % 13 = 0 THEN NULL ELSE id % {light} + 10 END"
    left = spark.range(900).selectExpr(f"CAST({key.format(own=2, name=-2, light=90)} AS INT) AS k", "IF(id % 3 = 0, 'x', 'y') AS j", "id AS a", "id AS v")
    right = spark.range(300).selectExpr(f"CAST({key.format(own=3, name=-3, light=120)} AS BIGINT) AS k", "IF(id % 2 = 0, 'x', 'z') AS j", "id AS b", "id AS v")
    return left, right


@pytest.mark.parametrize("how", joins.HOW)
@pytest.mark.parametrize("null_safe", [False, True])
@pytest.mark.parametrize("keys", ["k", ["k", "j"]])
def test_equals_the_plain_join(spark, how, null_safe, keys):
    left, right = sides(spark)
    plain = joins.join(left, right, keys, how, null_safe)
    found = skew.join_skewed(left, right, keys, how, null_safe, share=0.05, parts=6)
    assert found.columns == plain.columns
    state = [(r["n"], r["h"]) for df in (plain, found) for r in df.groupBy().agg(F.count("*").alias("n"), F.sum(F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in plain.columns]).cast("decimal(38,0)")).alias("h")).collect()]
    assert state[0] == state[1]
    assert plain.exceptAll(found).isEmpty()


@pytest.mark.parametrize("how", joins.HOW)
def test_empty_sides(spark, how):
    left, right = sides(spark)
    for a, b in ((left.limit(0), right), (left, right.limit(0)), (left.limit(0), right.limit(0))):
        assert sorted(map(tuple, skew.join_skewed(a, b, "k", how).collect()), key=repr) == sorted(map(tuple, joins.join(a, b, "k", how).collect()), key=repr)


def test_a_heavy_key_is_spread(spark):
    """Half of both sides have one key: the cells of its pairs are of equal size, and none has a large share of them."""
    left = spark.range(8000).selectExpr("IF(id % 2 = 0, -1, id) AS k", "id AS a")
    right = spark.range(400).selectExpr("IF(id % 2 = 0, -1, id) AS k", "id AS b")
    assert list(skew.heavy_keys(left, F.xxhash64("k"), 0.01).values()) == [0.5]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = skew.join_skewed(left, right, "k", parts=16).where("k = -1").groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    sizes = sorted(r["count"] for r in found)
    assert sum(sizes) == 4000 * 200 and len(sizes) >= 7 and sizes[-1] < 2.5 * sizes[len(sizes) // 2]


def test_bad_arguments(spark):
    left, right = sides(spark)
    for wrong in ({"how": "cross"}, {"share": 0.0}, {"share": 2.0}, {"parts": 0}):
        with pytest.raises(ToolkitError):
            skew.join_skewed(left, right, "k", **wrong)


@pytest.mark.parametrize("how", joins.HOW)
@pytest.mark.parametrize("null_safe", [False, True])
def test_totals_equal_those_of_the_pairs(spark, how, null_safe):
    left, right = (df.withColumn("v", F.expr("IF(v % 7 = 0, NULL, v)")) for df in sides(spark))
    pairs = joins.join(left, right, "k", how, null_safe).groupBy("k")
    plain = pairs.agg(F.count("*"), F.count("v_x"), F.count("v_y"), F.sum("v_x"), F.sum("v_y"))
    found = skew.join_totals(left, right, "k", "v", "v", how, null_safe=null_safe, share=0.05, parts=6)
    assert found.columns == ["k", "n", "left_n", "right_n", "left_sum", "right_sum"]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(map(tuple, plain.collect()), key=repr)


def test_totals_build_no_pairs(spark):
    """60,000,000,000 pairs of one key."""
    left, right = spark.range(300_000).selectExpr("0 AS k", "id AS a"), spark.range(200_000).selectExpr("0 AS k", "id AS b")
    found = skew.join_totals(left, right, "k", "a", "b", "outer").collect()
    assert list(map(tuple, found)) == [(0, 6 * 10**10, 6 * 10**10, 6 * 10**10, 299_999 * 150_000 * 200_000, 199_999 * 100_000 * 300_000)]
