"""Queries that write and read: datasets, formats, tables, files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from rowloom.operators import joins, sql
from rowloom.plans.catalog import TABLES, query, table
from rowloom.plans.event_queries import _ENVELOPE_SQL, envelope
from rowloom.session import scratch_path
from rowloom.sources import datasets, files, warehouse
from rowloom.sources.envelope import read_envelope


def _new(spark, name):
    return scratch_path(spark, name)


@query("read_source_parquet", "SELECT * FROM supplier")
def read_parquet(spark, folder):
    return files.read_source(spark, f"{folder}/supplier.parquet")


@query(
    "register_sources",
    "SELECT n_name, count(*) AS suppliers FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name",
)
def register_sources(spark, folder):
    return sql.sql_query(
        spark,
        "SELECT n_name, count(*) AS suppliers FROM s JOIN n ON s_nationkey = n_nationkey GROUP BY n_name",
        {"s": f"{folder}/supplier.parquet", "n": table(spark, folder, "nation")},
    )


@query("dataset_round_trip", "SELECT * FROM customer")
def dataset_round_trip(spark, folder):
    store = datasets.Datasets(spark, _new(spark, "datasets"))
    return store.read(store.write(table(spark, folder, "customer"), "customer"))


@query(
    "dataset_overwrite_in_place",
    "SELECT * FROM orders WHERE o_orderstatus = 'F'",
)
def dataset_overwrite(spark, folder):
    store = datasets.Datasets(spark, _new(spark, "datasets"))
    store.write(table(spark, folder, "orders"), "orders", partition_by="o_orderstatus")
    store.write(store.read("orders").filter("o_orderstatus = 'F'"), "orders")
    return store.read("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")


@query(
    "join_clustered_datasets",
    """SELECT o_orderkey, o_totalprice, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice
       FROM orders JOIN lineitem ON o_orderkey = l_orderkey""",
)
def join_clustered(spark, folder):
    """Two datasets clustered by the order key: their join needs no shuffle."""
    store = datasets.Datasets(spark, _new(spark, "datasets"))
    lines = table(spark, folder, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    store.write(table(spark, folder, "orders"), "orders", cluster_by="o_orderkey", buckets=16)
    store.write(lines, "lines", cluster_by="o_orderkey", buckets=16)
    joined = joins.join(store.read("orders"), store.read("lines"), "o_orderkey")
    return joined.select("o_orderkey", "o_totalprice", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")


@query(
    "list_and_describe_datasets",
    """SELECT 'orders' AS name, (SELECT count(*) FROM orders) AS "rows", 6 AS n_columns
       UNION ALL SELECT 'supplier', (SELECT count(*) FROM supplier), 4""",
)
def list_datasets(spark, folder):
    store = datasets.Datasets(spark, _new(spark, "datasets"))
    for name in ("orders", "supplier", "customer"):
        store.write(table(spark, folder, name), name)
    store.drop("customer")
    described = None
    for name in store.names():
        one = store.describe(name)
        described = one if described is None else described.unionByName(one)
    listed = store.list().select("name", F.size("columns").alias("n_columns"))
    return described.select("name", "rows").join(listed, "name")


def _register_export(fmt):
    @query(f"export_{fmt}", "SELECT * FROM part")
    def run(spark, folder):
        part = table(spark, folder, "part")
        path = datasets.export_dataset(part, fmt, _new(spark, f"export.{fmt}"))
        return files.read_source(spark, path, "jsonl" if fmt == "json" else fmt, part.schema)


for _fmt in datasets.EXPORT_FORMATS:
    _register_export(_fmt)


def _register_convert(source, target):
    @query(f"convert_{source}_to_{target}", "SELECT * FROM customer")
    def run(spark, folder):
        customer = table(spark, folder, "customer")
        first, second = _new(spark, f"from.{source}"), _new(spark, f"to.{target}")
        files.write_table(customer, first, source)
        line_form = {"json": "jsonl"}
        files.convert_format(spark, first, second, line_form.get(source, source), target, customer.schema)
        return files.read_source(spark, second, line_form.get(target, target), customer.schema)


for _source in ("parquet", "csv", "json"):
    for _target in ("parquet", "csv", "json"):
        _register_convert(_source, _target)


@query("export_json_multiline_text", "SELECT doc_id, md5(text) AS digest, lang, source, n_chars FROM documents")
def export_multiline(spark, folder):
    """Texts with quotes and line breaks survive as JSON lines, the form for such columns."""
    documents = table(spark, folder, "documents")
    path = datasets.export_dataset(documents, "json", _new(spark, "documents.json"))
    back = files.read_source(spark, path, "jsonl", documents.schema)
    return back.select("doc_id", F.md5("text").alias("digest"), "lang", "source", "n_chars")


def _table_name(prefix):
    return f"{prefix}_{uuid.uuid4().hex[:12]}"


@query(
    "ctas_export_partitioned",
    "SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders",
)
def ctas(spark, folder):
    table(spark, folder, "orders").createOrReplaceTempView("rowloom_ctas_orders")
    name, where = _table_name("orders"), _new(spark, "ctas")
    made = warehouse.ctas_export(
        spark,
        "SELECT o_orderkey, o_totalprice, o_orderpriority FROM rowloom_ctas_orders",
        name,
        "PARQUET",
        where,
        ["o_orderpriority"],
    )
    schema = made.schema
    spark.sql(f"DROP TABLE {name}")  # external: only the name goes, the files stay
    return spark.read.schema(schema).parquet(where)


@query(
    "list_partitions",
    """SELECT DISTINCT 'o_orderstatus=' || o_orderstatus AS "partition", o_orderstatus AS value, TRUE AS has_location FROM orders""",
)
def list_partitions(spark, folder):
    name = _table_name("orders")
    where = _new(spark, "partitioned")
    table(spark, folder, "orders").write.partitionBy("o_orderstatus").option("path", where).saveAsTable(name)
    found = warehouse.list_partitions(spark, name)
    spark.sql(f"DROP TABLE {name}")
    return found.select(
        "partition", F.col("values")[0].alias("value"), F.col("location").endswith(F.col("partition")).alias("has_location")
    )


@query("repair_partitions", "SELECT count(*) AS n, count(DISTINCT o_orderstatus) AS statuses FROM orders")
def repair_partitions(spark, folder):
    """A partition folder written by hand becomes visible."""
    name = _table_name("orders")
    where = _new(spark, "repair")
    orders = table(spark, folder, "orders")
    first = orders.filter("o_orderstatus <> 'P'")
    first.write.partitionBy("o_orderstatus").option("path", where).saveAsTable(name)
    orders.filter("o_orderstatus = 'P'").drop("o_orderstatus").write.parquet(f"{where}/o_orderstatus=P")
    warehouse.repair_partitions(spark, name)
    totals = spark.table(name).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_orderstatus").alias("statuses"))
    row = totals.collect()  # one row, taken while the table has its name
    spark.sql(f"DROP TABLE {name}")
    return spark.createDataFrame(row, totals.schema)


@query(
    "introspect_catalog",
    """SELECT 'supplier' AS "table", position, column_name, "type", TRUE AS nullable FROM (VALUES
         (0, 's_suppkey', 'bigint'), (1, 's_name', 'string'), (2, 's_nationkey', 'int'), (3, 's_acctbal', 'double')) v(position, column_name, "type")
       UNION ALL
       SELECT 'part', position, column_name, "type", TRUE FROM (VALUES
         (0, 'p_partkey', 'bigint'), (1, 'p_name', 'string'), (2, 'p_brand', 'string'), (3, 'p_type', 'string'), (4, 'p_size', 'int'),
         (5, 'p_retailprice', 'double')) v(position, column_name, "type")""",
)
def introspect(spark, folder):
    mark = uuid.uuid4().hex[:12]
    names = {n: f"cat_{mark}_{n}" for n in ("supplier", "part")}
    for source, name in names.items():
        table(spark, folder, source).write.option("path", _new(spark, name)).saveAsTable(name)
    found = warehouse.introspect_catalog(spark, "default", f"cat_{mark}%")
    for name in names.values():
        spark.sql(f"DROP TABLE {name}")
    short = F.regexp_replace("table_name", "^cat_[0-9a-f]+_", "")
    return found.select(short.alias("table"), "position", "column_name", "type", "nullable")


@query(
    "inspect_parquet",
    """SELECT (SELECT count(*) FROM lineitem) AS "rows", 11 AS n_columns, TRUE AS has_row_groups, 20 AS sampled""",
)
def inspect_parquet(spark, folder):
    facts = files.inspect_parquet(spark, f"{folder}/lineitem.parquet")
    sampled = facts["sample"].agg(F.count(F.lit(1)).cast("int").alias("n")).scalar()
    fields = facts["schema"].agg(F.count(F.lit(1)).cast("int").alias("n")).scalar()
    return facts["totals"].select(
        "rows", fields.alias("n_columns"), (F.col("row_groups") >= F.col("files")).alias("has_row_groups"), sampled.alias("sampled")
    )


@query(
    "file_inventory",
    f"SELECT unnest({[f'{t}.parquet' for t in sorted(TABLES)]}) AS name, TRUE AS has_bytes",
)
def file_inventory(spark, folder):
    """A row for each table, be it one file or a folder of files."""
    found = files.entry_totals(spark, files.file_inventory(spark, folder, glob="*.parquet"), folder)
    return found.select(F.col("entry").alias("name"), (F.col("bytes") > 0).alias("has_bytes"))


@query(
    "read_envelope",
    f"""SELECT "partition", "offset", "timestamp", "key", "value", event_type AS kind FROM ({_ENVELOPE_SQL})""",
)
def envelope_round_trip(spark, folder):
    path = _new(spark, "envelope")
    files.write_table(envelope(spark, folder), path, "parquet")
    back = read_envelope(spark, path)
    return back.withColumn("kind", F.col("headers")["kind"]).drop("headers")
