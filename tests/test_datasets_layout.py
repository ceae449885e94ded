"""Clustered datasets: plans without a shuffle, layouts known to later sessions, and writers that meet."""

from __future__ import annotations

import threading

import pytest
from pyspark.sql import functions as F

from rowloom.errors import ConflictError, ToolkitError, UnknownDatasetError
from rowloom.operators import compare, events, joins
from rowloom.plans.catalog import table
from rowloom.plans.inspect import plan_facts
from rowloom.sources import storage
from rowloom.sources.datasets import Datasets


@pytest.fixture
def store(spark, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield Datasets(spark, str(tmp_path / "datasets"))
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.unset("spark.sql.unionOutputPartitioning")


def test_no_shuffle_by_the_key(spark, folder, store):
    orders = table(spark, folder, "orders")
    store.write(orders, "a", cluster_by="o_orderkey", buckets=8)
    store.write(orders.withColumn("o_totalprice", F.col("o_totalprice") + (F.col("o_orderkey") % 7 == 0).cast("int")), "b", cluster_by="o_orderkey", buckets=8)
    for again in range(2):
        a, b = store.read("a"), store.read("b")
        for how in joins.HOW[:3]:
            joined = joins.join(a, b, "o_orderkey", how)
            assert plan_facts(joined).exchanges == 0 and joined.count() == orders.count()
        first = events.dedupe_by_id(a, "o_orderdate", id_cols="o_orderkey")
        assert plan_facts(first).exchanges == 0 and first.count() == orders.select("o_orderkey").distinct().count()
        assert plan_facts(joins.join(a, table(spark, folder, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey")).exchanges == 1
        # unions of clustered tables group rightly
        assert compare.diff_tables(a, b, "o_orderkey").keys.count() == orders.count()
        assert compare.reconcile_counts(a, b, "o_orderkey").counts.count() == joins.key_presence(a, b, "o_orderkey").count() == orders.count()
        # what another application would find: the files and their layout, but no entry in its catalog
        for r in spark.catalog.listTables():
            if r.name.startswith("rowloom_v_"):
                spark.sql(f"DROP TABLE {r.name}")


def test_clustered_values_and_versions(spark, store):
    df = spark.createDataFrame([(i % 5, None if i % 3 else "x", [i]) for i in range(50)], "`a key` int, s string, l array<int>")
    store.write(df, "d", cluster_by=["a key", "s"], buckets=3)
    first = store.version("d")
    assert sorted(map(tuple, store.read("d").collect()), key=repr) == sorted(map(tuple, df.collect()), key=repr)
    store.write(store.read("d").where("`a key` = 1"), "d")  # read and replaced in one plan, no longer clustered
    assert store.read("d").count() == 10 and store.version("d") != first and store.drop_old_versions("d") == 1
    store.write(df, "d", cluster_by="a key", buckets=2, replaces=store.version("d"))
    assert store.read("d").count() == 50
    store.drop("d")
    with pytest.raises(UnknownDatasetError):
        store.read("d")
    for wrong in ({"cluster_by": "absent"}, {"cluster_by": "s", "buckets": 0}, {"cluster_by": "s", "partition_by": "s"}):
        with pytest.raises(ToolkitError):
            store.write(df, "e", **wrong)


def test_of_two_writers_one_finds_out(spark, store):
    store.write(spark.range(1), "d")
    seen = store.version("d")
    store.write(spark.range(2), "d", replaces=seen)
    with pytest.raises(ConflictError):
        store.write(spark.range(3), "d", replaces=seen)
    assert store.read("d").count() == 2
    # both have seen the same version and write at the same time
    seen, wait, results = store.version("d"), threading.Barrier(6), []

    def write(rows):
        wait.wait()
        try:
            store.write(spark.range(rows), "d", replaces=seen, **({"cluster_by": "id", "buckets": 2} if rows % 2 else {}))
            results.append(rows)
        except ConflictError:
            pass

    threads = [threading.Thread(target=write, args=(10 + i,)) for i in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(results) == 1 and store.read("d").count() == results[0]
    # without an expectation the last one counts, and none is lost halfway
    threads = [threading.Thread(target=lambda n=n: store.write(spark.range(n), "d")) for n in (20, 21, 22)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert store.read("d").count() in (20, 21, 22)


def test_a_name_is_taken_once(spark, tmp_path):
    path, made = f"{tmp_path}/p-1", []
    threads = [threading.Thread(target=lambda i=i: made.append((storage.create_text(spark, path, f"writer {i}"), i))) for i in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    winner = [i for ok, i in made if ok]
    assert len(winner) == 1 and storage.read_text(spark, path) == f"writer {winner[0]}" and len(list(tmp_path.glob("_draft*"))) == 0
