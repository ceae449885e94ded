"""Queries over documents and payloads: whole ones of every row, and beside them those that cannot be read."""

from __future__ import annotations

import pytest

from rowloom.operators import flatten, json_ops
from rowloom.plans.catalog import load_all

ENTRIES = load_all()


@pytest.fixture(scope="module")
def orders(spark, tmp_path_factory):
    """Two urgent orders, one without lines, and another one of the first's buyer."""
    folder = str(tmp_path_factory.mktemp("orders"))
    data = [(1, 7, "O", 10.5, "1-URGENT"), (2, 7, "O", 20.5, "5-LOW"), (3, 8, "F", 30.5, "1-URGENT")]
    names = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderpriority string"
    spark.createDataFrame(data, names).write.parquet(f"{folder}/orders.parquet")
    lines = [(1, 1, 45.0, "N"), (1, 2, 35.0, "R"), (2, 1, 50.0, "A")]
    names = "l_orderkey bigint, l_linenumber int, l_quantity double, l_returnflag string"
    spark.createDataFrame(lines, names).write.parquet(f"{folder}/lineitem.parquet")
    return folder


def test_projection_of_broken_documents_is_null(spark, orders, rows):
    found = rows(ENTRIES["json_extract_projection"].run(spark, orders))
    assert found == [(1, "N,R", 2, "O"), (1, None, None, None), (2, "A", 1, "O"), (3, "", 0, "F"), (3, None, None, None)]


def test_object_of_broken_documents_is_null(spark, orders, rows):
    found = rows(ENTRIES["json_extract_object"].run(spark, orders))
    assert found == [(1, '{"buyer":7,"no":1}'), (1, None), (2, '{"buyer":7,"no":2}'), (3, '{"buyer":8,"no":3}'), (3, None)]


def seen_by(monkeypatch, module, name) -> list:
    """The tables that an operator is given from here on."""
    tables, operator = [], getattr(module, name)
    monkeypatch.setattr(module, name, lambda df, *rest, **named: (tables.append(df), operator(df, *rest, **named))[1])
    return tables


def test_truthy_leaves_out_broken_documents_only(spark, orders, rows, monkeypatch):
    given = seen_by(monkeypatch, json_ops, "filter_by_path")
    assert rows(ENTRIES["filter_by_path_truthy"].run(spark, orders)) == [(1,), (2,)]
    assert rows(flatten.json_defects(given[0], "doc"), "rows", "invalid", "valid") == [(5, 2, 3)]


def test_targets_leave_out_broken_documents_only(spark, orders, rows, monkeypatch):
    given = seen_by(monkeypatch, flatten, "parse_json_column")
    found = rows(ENTRIES["parse_json_targets"].run(spark, orders))
    assert found == [(1, 1, 7, "O", None), (2, 2, 7, "O", None), (3, 3, 8, "F", None)]
    assert rows(flatten.json_defects(given[0], "doc"), "rows", "invalid", "valid") == [(5, 2, 3)]


def test_broken_documents_are_counted_as_skipped(spark, orders, rows):
    assert rows(ENTRIES["dedupe_counts"].run(spark, orders)) == [(5, 2, 2)]


@pytest.fixture(scope="module")
def documents(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("documents"))
    data = [(1, "plain", "en", 900), (2, "rahmen", "de", 900), (3, "fr", "fr", 900), (4, "largo", "es", 900), (5, "corto", "es", 5), (6, "?", None, 900)]
    spark.createDataFrame(data, "doc_id bigint, text string, lang string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    return folder


def test_empty_payloads_are_counted_beside_whole_ones(spark, documents, rows):
    found = rows(ENTRIES["triage_counts"].run(spark, documents))
    assert found == [("binary", None, 4), ("empty", None, 2), ("framed", 900, 1), ("text", None, 1)]


def test_empty_payloads_come_through_the_stream(spark, documents, rows):
    found = rows(ENTRIES["stream_triage"].run(spark, documents))
    kinds = [(1, "text", None), (2, "framed", 900), (3, "binary", None), (4, "binary", None), (4, "empty", None), (5, "binary", None)]
    assert found == kinds + [(6, "binary", None), (6, "empty", None)]
