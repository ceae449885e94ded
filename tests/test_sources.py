"""SQL, files, datasets, warehouse tables."""

from __future__ import annotations

import datetime as dt
import json

import pytest

from rowloom.errors import ReadOnlyError, ToolkitError, UnknownDatasetError
from rowloom.operators import sql
from rowloom.sources import datasets, files, warehouse

GOOD = [
    "SELECT * FROM t WHERE action = 'delete'",
    "SELECT 'it''s; a drop' AS x",
    "-- drop nothing\nSELECT 1",
    "(SELECT 1)",
    "SELECT 1",
    "select\n1",
    "WITH t AS (SELECT 1 AS a) SELECT * FROM t",
    "EXPLAIN SELECT 1",
    "SELECT created, update_time FROM t",
]
BAD = [
    "SELECT java_method('java.lang.System', 'getProperty', 'user.home')",
    "SELECT reflect ('a', 'b')",
    "SELECT 1 /* ; */ ; SELECT 2",
    "SELECT 1;",
    "DROP TABLE t",
    "INSERT INTO t VALUES (1)",
    "UPDATE t SET a = 1",
    "DELETE FROM t",
    "SHOW TABLES",
    "WITH t AS (SELECT 1) DELETE\nFROM t",
    "EXPLAIN DROP TABLE t",
    "",
]


@pytest.mark.parametrize("text", GOOD)
def test_read_only_passes(text):
    assert sql.read_only(f"  {text} ") == text


@pytest.mark.parametrize("text", BAD)
def test_read_only_refuses(text):
    with pytest.raises(ReadOnlyError):
        sql.read_only(text)


def test_sql_over_sources(spark, rows):
    df = spark.createDataFrame([(1, "low"), (8, "high")], "x int, k string")
    assert rows(sql.sql_query(spark, "SELECT count(*) AS n FROM t WHERE x > :low", {"t": df}, {"low": 5})) == [(1,)]
    assert rows(sql.sql_query(spark, "SELECT x FROM t WHERE k = ?", {"t": df}, ["low"])) == [(1,)]
    assert sql.sql_query(spark, "SELECT * FROM range(100)", max_rows=7).count() == 7
    assert not any(t.name == "t" for t in spark.catalog.listTables())


def test_sql_sources_do_not_replace_views_of_the_session(spark, rows):
    spark.range(3).createOrReplaceTempView("mine")
    try:
        assert rows(sql.sql_query(spark, "SELECT count(*) AS n FROM mine", {"mine": spark.range(9)})) == [(9,)]
        assert spark.table("mine").count() == 3
    finally:
        spark.catalog.dropTempView("mine")


def test_unknown_table_names_the_sources(spark):
    with pytest.raises(ToolkitError, match="known_one"):
        sql.sql_query(spark, "SELECT * FROM nowhere", {"known_one": spark.range(1)})


def test_explain(spark):
    plan = sql.explain_query(spark, "SELECT id FROM t WHERE id > 1", {"t": spark.range(5)}).first()[0]
    assert "Physical Plan" in plan
    with pytest.raises(ReadOnlyError):
        sql.explain_query(spark, "DROP TABLE t")


PRODUCTS = [
    {"id": 1, "name": "Widget", "price": 29.99, "in_stock": True, "tags": ["a"], "metadata": {"x": 1}},
    {"id": 2, "name": "Gadget", "price": 149.99, "in_stock": False, "tags": [], "metadata": {"y": "z"}},
    {"id": 3, "name": "Tool", "price": 79.5, "in_stock": True, "tags": ["a", "b"], "metadata": {}},
]


def test_json_array_file(spark, tmp_path):
    path = tmp_path / "products.json"
    path.write_text(json.dumps(PRODUCTS, indent=1))
    found = sql.sql_query(spark, "SELECT id, price FROM p WHERE price > 50 ORDER BY price DESC", {"p": str(path)}).collect()
    assert [r["price"] for r in found] == [149.99, 79.5]


def test_json_lines_and_csv(spark, tmp_path, rows):
    lines = tmp_path / "events.jsonl"
    lines.write_text(
        "\n".join(
            json.dumps(e)
            for e in [
                {"event_id": "e1", "event_type": "purchase", "user_id": "u1", "amount": 99.99},
                {"event_id": "e2", "event_type": "view", "user_id": "u1", "amount": None},
                {"event_id": "e3", "event_type": "purchase", "user_id": "u2", "amount": 149.99},
            ]
        )
    )
    query = "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(sum(amount), 2) AS total FROM e WHERE event_type = 'purchase' GROUP BY event_type"
    assert rows(sql.sql_query(spark, query, {"e": str(lines)})) == [("purchase", 2, 2, 249.98)]
    table = tmp_path / "orders.csv"
    table.write_text(
        "order_id,customer_id,product,quantity,unit_price,status\no1,1001,W,3,29.99,completed\no2,1002,G,1,49.99,completed\n"
        "o3,1001,T,2,29.99,pending\no4,1003,X,1,9.99,cancelled\n"
    )
    query = "SELECT customer_id, round(sum(quantity * unit_price), 2) AS total FROM o WHERE status <> 'cancelled' GROUP BY customer_id ORDER BY total DESC"
    assert [tuple(r) for r in sql.sql_query(spark, query, {"o": str(table)}).collect()] == [(1001, 149.95), (1002, 49.99)]
    assert files.read_source(spark, str(table), schema="order_id string").columns == ["order_id"]


def test_unknown_formats(spark):
    with pytest.raises(ToolkitError):
        files.read_source(spark, "/x/y.xlsx")
    with pytest.raises(ToolkitError):
        datasets.export_dataset(spark.range(1), "excel", "/tmp/never")


def test_convert_keeps_quotes_and_nulls(spark, tmp_path, rows):
    df = spark.createDataFrame([(1, 'say "hi", ok'), (2, None)], "a int, b string")
    first = files.write_table(df, str(tmp_path / "one.csv"), "csv")
    second = files.convert_format(spark, first, str(tmp_path / "two.json"), schema=df.schema)
    third = files.convert_format(spark, second, str(tmp_path / "three.parquet"), in_fmt="jsonl")
    assert [tuple(r) for r in spark.read.parquet(third).orderBy("a").collect()] == [(1, 'say "hi", ok'), (2, None)]


def test_inspect_parquet_and_inventory(spark, tmp_path, rows):
    path = str(tmp_path / "t.parquet")
    spark.range(1000).repartition(3).write.parquet(path)
    facts = files.inspect_parquet(spark, path, sample_rows=5)
    totals = facts["totals"].first()
    assert (totals["files"], totals["rows"], facts["sample"].count()) == (3, 1000, 5)
    assert totals["row_groups"] >= 3
    assert rows(facts["schema"], "name", "type") == [("id", "bigint")]
    inventory = files.file_inventory(spark, path, prefix="part-")
    assert inventory.count() == 3
    total = files.folder_totals(inventory).first()
    assert total["files"] == 3 and total["bytes"] > 0


def test_inventory_by_entry(spark, tmp_path, rows):
    """A table may be a file or a folder, of more than one level."""
    spark.range(1000).repartition(3).write.parquet(str(tmp_path / "in" / "b.parquet"))
    spark.range(9).selectExpr("id", "id % 2 AS k").coalesce(1).write.partitionBy("k").parquet(str(tmp_path / "in" / "c.parquet"))
    one = next((tmp_path / "in" / "b.parquet").glob("part-*.parquet"))
    (tmp_path / "in" / "a.parquet").write_bytes(one.read_bytes())
    for path in (f"{tmp_path}/in", f"file://{tmp_path}/in/"):
        totals = files.entry_totals(spark, files.file_inventory(spark, path, glob="*.parquet"), path)
        assert rows(totals, "entry", "files") == [("a.parquet", 1), ("b.parquet", 3), ("c.parquet", 2)]
        assert totals.where(f"entry = 'a.parquet' AND bytes = {one.stat().st_size}").count() == 1


def test_datasets(spark, tmp_path, rows):
    store = datasets.Datasets(spark, str(tmp_path / "store"))
    assert store.names() == []
    store.put_rows(["a", "b"], [[1, 2], [3, 4]], "two_ints")
    assert rows(store.read("two_ints")) == [(1, 2), (3, 4)]
    described = store.describe("two_ints").first()
    assert (described["rows"], described["columns"]) == (2, ["a", "b"])
    store.write(store.read("two_ints").filter("a > 1"), "two_ints")
    assert rows(store.read("two_ints")) == [(3, 4)]
    assert store.drop_old_versions("two_ints") == 1
    made = store.write(spark.range(3))
    assert made.startswith("dataset_") and store.list().count() == 2
    store.drop(made)
    assert store.names() == ["two_ints"]
    for name in ("../x", "a/b", ""):
        with pytest.raises(ToolkitError):
            store.read(name)
    with pytest.raises(UnknownDatasetError):
        store.drop("nope")
    with pytest.raises(ToolkitError):
        store.put_rows(["a"], [[1, 2]])


def test_failed_write_leaves_the_dataset(spark, tmp_path, rows):
    store = datasets.Datasets(spark, str(tmp_path / "store"))
    store.put_rows(["a"], [[1]], "d")
    with pytest.raises(Exception):
        store.write(spark.sql("SELECT raise_error('stop') AS a"), "d")
    assert rows(store.read("d")) == [(1,)]


def test_warehouse_tables(spark, tmp_path, rows):
    name = "warehouse_test"
    text = "SELECT id, CAST(id % 2 AS INT) AS p FROM range(10)"
    made = warehouse.ctas_export(spark, text, name, "ORC", str(tmp_path / "t"), "p")
    try:
        assert made.count() == 10
        listed = warehouse.list_partitions(spark, name).collect()
        assert [(r["partition"], r["values"]) for r in listed] == [("p=0", ["0"]), ("p=1", ["1"])]
        assert all(r["location"].endswith(r["partition"]) for r in listed)
        assert warehouse.list_partitions(spark, name, 1).count() == 1
        spark.range(5).write.orc(str(tmp_path / "t" / "p=7"))
        assert warehouse.repair_partitions(spark, name).count() == 3
        assert spark.table(name).count() == 15
        columns = warehouse.introspect_catalog(spark, table_like="warehouse%").collect()
        assert [(r["column_name"], r["type"]) for r in columns] == [("id", "bigint"), ("p", "int")]
        with pytest.raises(Exception):
            warehouse.ctas_export(spark, text, name)
    finally:
        spark.sql(f"DROP TABLE {name}")
    with pytest.raises(ReadOnlyError):
        warehouse.ctas_export(spark, "DROP TABLE x", "y")
    with pytest.raises(ToolkitError):
        warehouse.ctas_export(spark, text, "y", "XML")


def test_jdbc_options():
    plain = warehouse.jdbc_options("jdbc:x", "SELECT * FROM t WHERE a = ? AND b = '?' AND c < ?", ["it's", dt.date(2024, 1, 2)])
    assert plain["query"] == "SELECT * FROM t WHERE a = 'it''s' AND b = '?' AND c < DATE '2024-01-02'"
    split = warehouse.jdbc_options("jdbc:x", "SELECT * FROM t", partition_column="id", bounds=(0, 100), num_partitions=4)
    assert (split["dbtable"], split["partitionColumn"], split["numPartitions"]) == ("(SELECT * FROM t) q", "id", "4")
    for wrong in (
        {"query": "DELETE FROM t"},
        {"query": "SELECT ?"},
        {"query": "SELECT 1", "params": [1]},
        {"query": "SELECT 1", "num_partitions": 2},
    ):
        with pytest.raises(ToolkitError):
            warehouse.jdbc_options("jdbc:x", **wrong)


def test_partitions_with_escaped_and_null_values(spark):
    name = "escaped_partitions"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    try:
        spark.createDataFrame([(1, "a b:c"), (2, None), (3, "x")], "v int, p string").write.partitionBy("p").saveAsTable(name)
        found = warehouse.list_partitions(spark, name).collect()
        assert sorted((r["values"] for r in found), key=repr) == [["a b:c"], ["x"], [None]]
        assert all(r["location"] for r in found)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_scratch_is_never_machine_local(spark):
    from rowloom.session import scratch_root

    assert scratch_root(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
