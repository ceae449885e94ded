"""Every registered query against DuckDB on the same tables."""

from __future__ import annotations

import importlib
import subprocess
import sys

import oracle
import pytest

from rowloom.plans.catalog import load_all

ENTRIES = load_all()


@pytest.fixture(scope="module")
def duck(folder):
    connection = oracle.connect(folder)
    yield connection
    connection.close()


@pytest.mark.parametrize("name", [n for n, e in ENTRIES.items() if e.sql])
def test_query_equals_sql(spark, folder, duck, name):
    assert oracle.differences(spark, folder, ENTRIES[name], duck) == []


@pytest.mark.parametrize("name", [n for n, e in ENTRIES.items() if not e.sql])
def test_query_without_sql_gives_rows(spark, folder, name):
    assert ENTRIES[name].run(spark, folder).count() > 0


def test_entry_points(spark):
    module = importlib.import_module("__spark_entry__")
    assert set(module.oracle_sql()) <= set(module.queries())
    assert 0 < module.entry(spark).count() <= 20


def test_queries_can_be_listed_before_spark_starts():
    code = "import __spark_entry__ as e; assert len(e.queries()) > 100 and len(e.oracle_sql()) > 100"
    root = importlib.import_module("conftest").ROOT
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
