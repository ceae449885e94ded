"""Shapes of physical plans: pushdown, pruning, shuffles, no Python."""

from __future__ import annotations

import pytest

from rowloom.operators import aggregate, compare, events, joins, select
from rowloom.plans.catalog import load_all, table
from rowloom.plans.inspect import is_scan, plan_facts, plan_text
from rowloom.session import scratch_root

ENTRIES = load_all()
# footers are read by Python workers; all other queries stay in the JVM
PYTHON_ALLOWED = {"inspect_parquet"}
EAGER = ("stream_", "convert_", "export_", "dataset_", "evidence", "list_", "ctas", "repair", "introspect")


@pytest.mark.parametrize("name", [n for n in ENTRIES if not n.startswith(EAGER) and n not in PYTHON_ALLOWED])
def test_no_python_in_plans(spark, folder, name):
    assert plan_facts(ENTRIES[name].run(spark, folder)).python_nodes == 0


def test_filters_reach_the_files(spark, folder):
    events_table = table(spark, folder, "events")
    equal = plan_facts(select.filter_rows(events_table, [{"column": "event_type", "op": "==", "value": "view"}]))
    assert "EqualTo(event_type,view)" in equal.pushed_filters[0]
    span = plan_facts(select.filter_time_range(table(spark, folder, "lineitem"), "l_shipdate", "1996-01-01", "1996-02-01"))
    assert "GreaterThanOrEqual(l_shipdate" in span.pushed_filters[0] and "LessThanOrEqual(l_shipdate" in span.pushed_filters[0]
    above = plan_facts(select.filter_rows(events_table, [{"column": "value", "op": ">", "value": 5.0}]))
    assert "GreaterThan(value,5.0)" in above.pushed_filters[0]


def test_only_needed_columns_are_read(spark, folder):
    facts = plan_facts(aggregate.group_aggregate(table(spark, folder, "lineitem"), "l_returnflag", {"l_tax": "max"}))
    assert facts.read_schemas == ("struct<l_tax:double,l_returnflag:string>",)
    total = plan_facts(table(spark, folder, "lineitem").groupBy().count())
    assert total.read_schemas == ("struct<>",)


def test_samples_and_top_rows_need_no_full_sort(spark, folder):
    orders = table(spark, folder, "orders")
    assert "TakeOrderedAndProject" in plan_text(select.sample_random(orders, 10, "o_orderkey"))
    assert "TakeOrderedAndProject" in plan_text(select.head_tail(orders, "o_orderkey", 5, 5))


@pytest.mark.parametrize("name", ["sample_stratified", "dedupe_by_columns", "dedupe_by_path", "read_tail", "group_by_path"])
def test_groups_are_cut_down_before_the_shuffle(spark, folder, name):
    assert "WindowGroupLimit" in plan_text(ENTRIES[name].run(spark, folder))


def test_comparison_shuffles_once(spark, folder):
    orders = table(spark, folder, "orders")
    assert plan_facts(compare.diff_tables(orders, orders.filter("o_totalprice > 10"), "o_orderkey").keys).exchanges == 1
    assert plan_facts(compare.reconcile_counts(orders, orders, "o_custkey").counts).exchanges == 1
    assert plan_facts(joins.key_presence(orders, orders, "o_custkey")).exchanges == 1


def shuffled_records(spark, action) -> int:
    """Records that all stages of an action wrote for shuffles."""

    def total():
        store = spark.sparkContext._jsc.sc().statusStore()
        none = spark._jvm.java.util.ArrayList()
        quantiles = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
        stages = store.stageList(none, False, False, quantiles, none)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = total()
    action()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return total() - before


def test_equal_tables_shuffle_only_checksums(spark, folder):
    orders = table(spark, folder, "orders")

    def compared(other, by_checksum):
        use = compare.diff_by_checksum if by_checksum else compare.diff_tables
        parts = {"buckets": 16} if by_checksum else {}
        return lambda: use(orders, other, "o_orderkey", **parts).summary.collect()

    rows = orders.count()
    assert shuffled_records(spark, compared(orders, False)) >= 2 * rows
    # 16 checksums for each side and task, and one row for each of a few totals
    assert shuffled_records(spark, compared(orders, True)) < 100
    dearer = orders.o_totalprice + (orders.o_orderkey == orders.agg({"o_orderkey": "min"}).first()[0]).cast("int")
    changed = orders.withColumn("o_totalprice", dearer)
    assert shuffled_records(spark, compared(changed, True)) < rows / 4


def test_null_safe_join_is_an_equi_join(spark, folder):
    orders, customer = table(spark, folder, "orders"), table(spark, folder, "customer")
    left, right = orders.selectExpr("o_custkey AS k", "o_orderkey"), customer.selectExpr("c_custkey AS k", "c_name")
    for how in joins.HOW:
        text = plan_text(joins.join(left, right, "k", how, null_safe=True))
        assert "NestedLoop" not in text and "CartesianProduct" not in text
        assert "FullOuter" not in text  # AQE cannot split a hot key of one


def test_no_query_pairs_rows_without_keys(spark, folder):
    for name, entry in ENTRIES.items():
        if not name.startswith(EAGER):
            text = plan_text(entry.run(spark, folder))
            assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_json_texts_are_parsed_once(spark, folder):
    text = plan_text(ENTRIES["parse_json_targets"].run(spark, folder))
    assert text.count("parseJson") == 1


def test_scans_are_told_from_derived_tables(spark, folder):
    orders = table(spark, folder, "orders")
    assert is_scan(orders) and is_scan(orders.filter("o_custkey > 5").select("o_custkey"))
    assert not is_scan(orders.distinct())
    assert not is_scan(events.dedupe_by_id(orders, "o_orderkey", id_cols="o_custkey"))


def test_written_intermediates_go_to_the_shared_folder(spark):
    assert scratch_root(spark) == spark.conf.get("spark.checkpoint.dir")
