"""Registry of the ready-made queries and of the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


@dataclass(frozen=True)
class Entry:
    name: str
    run: Query
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register ``run(spark, folder)`` under a name, with the SQL giving the same rows."""

    def register(run: Query) -> Query:
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = Entry(name, run, sql)
        return run

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def load_all() -> dict[str, Entry]:
    """Import every query module and return the registry."""
    from rowloom.plans import (  # noqa: F401
        event_queries,
        quality_queries,
        source_queries,
        sql_queries,
        stream_queries,
        table_queries,
    )

    return REGISTRY
