"""Profiles from stored sketches: merged states, error bounds, appended, replaced and deleted files."""

from __future__ import annotations

import math
import os
import random
import statistics

import numpy as np
import pytest

from rowloom.errors import ToolkitError
from rowloom.operators import sketches

SCHEMA = "k long, x double, s string, d date, empty double, b boolean"


def rows(seed, n):
    rng = random.Random(seed)
    return [
        (rng.randrange(5000), rng.choice([None, float("nan"), *[rng.gauss(0, 100)] * 20]), rng.choice(["é", "b", None, f"t{rng.randrange(300)}"]), None, None, i % 2 == 0)
        for i in range(n)
    ]


@pytest.fixture
def folder(spark, tmp_path):
    path = str(tmp_path / "data")

    def add(given, files=3):
        spark.createDataFrame(given, SCHEMA).repartition(files).write.mode("append").parquet(path)

    return path, str(tmp_path / "store"), add


def test_only_new_files_are_read(spark, folder, monkeypatch):
    path, store, add = folder
    read = []
    states = sketches.file_states
    monkeypatch.setattr(sketches, "file_states", lambda df, *a: read.append(len(df.inputFiles())) or states(df, *a))
    add(rows(1, 500))
    assert sketches.refresh_sketches(spark, path, store) == 3 and sketches.refresh_sketches(spark, path, store) == 0
    add(rows(2, 700), 2)
    assert sketches.refresh_sketches(spark, path, store) == 2 and read == [3, 2]
    found = {r["column"]: r for r in sketches.sketched_profile(spark, path, store).collect()}
    given = rows(1, 500) + rows(2, 700)
    x = [r[1] for r in given if r[1] is not None and not math.isnan(r[1])]
    assert found["x"]["n_rows"] == 1200 and found["x"]["missing"] == 1200 - len(x)
    assert found["x"]["mean"] == pytest.approx(statistics.fmean(x)) and found["x"]["std"] == pytest.approx(statistics.stdev(x))
    assert float(found["x"]["minimum"]) == min(x) and float(found["x"]["maximum"]) == max(x)
    assert found["empty"]["missing"] == 1200 and found["empty"]["p50"] is None and found["empty"]["distinct_estimate"] == 0
    assert found["s"]["minimum"] == "b" and found["s"]["maximum"] == "é" and found["s"]["p50"] is None
    for name, at in (("k", 0), ("s", 2), ("x", 1)):
        exact = len({r[at] for r in given if r[at] is not None and r[at] == r[at]})
        assert abs(found[name]["distinct_estimate"] - exact) <= 4 * sketches.DISTINCT_ERROR * exact + 1


def test_quantiles_stay_within_the_rank_error(spark, folder):
    path, store, _ = folder
    spark.range(200_000).selectExpr("(id * 7919) % 200000 AS v", "CAST(pow(id % 1000, 3) AS DOUBLE) AS w").repartition(7).write.parquet(path)
    sketches.refresh_sketches(spark, path, store)
    quantiles = (0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99)
    found = {r["column"]: r for r in sketches.sketched_profile(spark, path, store, quantiles).collect()}
    for q in quantiles:
        assert abs(found["v"][sketches._quantile_name(q)] / 200_000 - q) <= sketches.RANK_ERROR
    exact = {(r["column"], r["q"]): r["value"] for r in sketches.exact_quantiles_from(spark, path, store, ["v", "w"], quantiles).collect()}
    w = np.array([(i % 1000) ** 3 for i in range(200_000)], float)
    for q in quantiles:
        assert exact["v", q] == pytest.approx(q * 199_999) and exact["w", q] == pytest.approx(np.quantile(w, q))


def test_replaced_deleted_and_empty_files(spark, folder):
    path, store, add = folder
    add(rows(1, 90))
    sketches.refresh_sketches(spark, path, store, ["k", "x"])
    gone = sorted(f for f in os.listdir(path) if f.endswith(".parquet"))[0]
    os.unlink(os.path.join(path, gone))
    add(rows(5, 40), 1)
    spark.createDataFrame([], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    first = sketches.refresh_sketches(spark, path, store)
    assert first >= 1 and sketches.refresh_sketches(spark, path, store) == 0
    found = sketches.sketched_profile(spark, path, store).collect()
    assert sorted(r["column"] for r in found) == ["k", "x"]  # the store keeps to its columns
    assert {r["n_rows"] for r in found} == {spark.read.parquet(path).count()}
    add(rows(6, 30), 1)
    assert sketches.refresh_sketches(spark, path, store) == 1
    found = sketches.sketched_profile(spark, path, store).collect()
    assert sorted((r["column"], r["n_rows"]) for r in found) == [(c, spark.read.parquet(path).count()) for c in ("k", "x")]


def test_exact_quantiles_sketch_what_is_new(spark, folder):
    path, store, add = folder
    add(rows(1, 50))
    k = sorted(r[0] for r in rows(1, 50))
    found = sketches.exact_quantiles_from(spark, path, store, "k", (0.0, 0.5, 1.0)).collect()
    assert sorted((r["q"], r["value"]) for r in found) == [(0.0, k[0]), (0.5, (k[24] + k[25]) / 2), (1.0, k[-1])]
    with pytest.raises(ToolkitError):
        sketches.exact_quantiles_from(spark, path, store, "s")
