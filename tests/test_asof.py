"""As-of joins against a search of all right rows."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from pyspark.sql import functions as F

from rowloom.errors import ToolkitError
from rowloom.operators import asof

LEFT, RIGHT = "k string, j int, t timestamp_ntz, v int, m map<string,int>", "k string, j int, t timestamp_ntz, v int, w string"


def at(hours):
    return None if hours is None else dt.datetime(2024, 1, 1) + dt.timedelta(hours=hours)


def brute(left, right, direction, equal, hours):
    out = []
    for row in left:
        best = None
        for other in right:
            if None in (*row[:3], *other[:3]) or row[:2] != other[:2]:
                continue
            apart = (row[2] - other[2]) if direction == "backward" else (other[2] - row[2])
            if apart < dt.timedelta(0) or (not equal and not apart) or (hours is not None and apart > dt.timedelta(hours=hours)):
                continue
            # of right rows of one time the one whose v is largest
            if best is None or (apart, -other[3]) < (best[0], -best[1][3]):
                best = (apart, other)
        out.append((*row[:4], *(best[1][2:] if best else (None, None, None))))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def sides():
    rng = random.Random(8)

    def rows(n, last):
        keys = ["hot"] * 6 + ["a", "b", None]
        return [(rng.choice(keys), rng.choice([1, 1, 1, 2, None]), at(rng.choice([None, *range(40)] * 2 + [500])), i, last(i)) for i in range(n)]

    return rows(300, lambda i: {"x": i}), rows(200, lambda i: f"w{i}")


@pytest.mark.parametrize("direction", asof.DIRECTIONS)
@pytest.mark.parametrize("equal", [True, False])
@pytest.mark.parametrize("hours", [None, 3])
def test_asof_equals_brute_force(spark, sides, direction, equal, hours):
    left, right = sides
    a, b = spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT)
    tolerance = None if hours is None else f"{hours} hours"
    found = asof.asof_join(a, b, ["k", "j"], "t", direction=direction, allow_equal=equal, tolerance=tolerance, tie="v")
    assert found.columns == ["k", "j", "t_x", "v_x", "m", "t_y", "v_y", "w"]
    expected = brute(left, right, direction, equal, hours)
    assert sorted((tuple(r) for r in found.drop("m").collect()), key=repr) == expected
    inner = asof.asof_join(a, b, ["k", "j"], "t", direction=direction, allow_equal=equal, tolerance=tolerance, how="inner", tie="v")
    assert sorted(tuple(r)[:5] for r in inner.drop("m").collect()) == sorted(r[:5] for r in expected if r[4])


def test_a_hot_key_is_spread_over_ranges(spark, monkeypatch):
    written, materialize = [], asof.materialize
    monkeypatch.setattr(asof, "materialize", lambda df, name: written.append(materialize(df, name)) or written[-1])
    left = spark.range(4000).selectExpr("'k' AS k", "id * 2 AS t", "id AS v")
    right = spark.range(40).selectExpr("'k' AS k", "id * 200 AS t", "id AS w")
    # few rows would share one range
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = asof.asof_join(left, right, "k", "t")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found.where("w <> t_x DIV 200").isEmpty() and found.count() == 4000
    ranges = written[0].selectExpr("shiftright(__at, 33) AS r").groupBy("r").count().collect()
    assert len(ranges) == 8 and max(r["count"] for r in ranges) < 2 * 4040 / 8


def test_empty_sides_and_bad_arguments(spark):
    a = spark.createDataFrame([("k", 1, at(1), 2, None)], LEFT)
    b = spark.createDataFrame([], RIGHT)
    assert [tuple(r) for r in asof.asof_join(a, b, "k", "t").collect()] == [("k", 1, at(1), 2, None, None, None, None, None)]
    assert asof.asof_join(b, b, "k", "t").collect() == [] and asof.asof_join(a, b, "k", "t", how="inner").collect() == []
    for wrong in ({"direction": "nearest"}, {"how": "outer"}, {"tolerance": "1' day"}, {"right_ts": "absent"}):
        with pytest.raises(ToolkitError):
            asof.asof_join(a, b, "k", "t", **wrong)


def test_ranges_follow_the_rows(spark, monkeypatch):
    """Ten times the rows are dealt to ten times the ranges, whatever the number of shuffle partitions is."""
    monkeypatch.setattr(asof, "RANGE_ROWS", 500)
    for n in (1000, 10_000):
        left = spark.range(n).selectExpr("0 AS k", "timestamp_seconds(id) AS t", "id AS a")
        right = spark.range(n).selectExpr("0 AS k", "timestamp_seconds(id) AS t", "id AS b")
        found = asof.asof_join(left, right, "k", "t")
        sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == n and max(sizes) <= 2500
        assert found.where("a = b").count() == n
