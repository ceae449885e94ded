"""Facts about a DataFrame's physical plan, for tests and tuning."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class PlanFacts:
    text: str
    exchanges: int
    python_nodes: int
    pushed_filters: tuple[str, ...]
    read_schemas: tuple[str, ...]


def plan_text(df: DataFrame) -> str:
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


def plan_facts(df: DataFrame) -> PlanFacts:
    text = plan_text(df)
    tree = text.split("\n\n\n")[0]
    return PlanFacts(
        text=text,
        exchanges=len(re.findall(r"(?<![a-zA-Z])Exchange \(", tree)),
        python_nodes=len(re.findall(r"(BatchEvalPython|ArrowEvalPython|MapInPandas|FlatMapGroupsInPandas)", tree)),
        pushed_filters=tuple(re.findall(r"PushedFilters: (\[.*\])", text)),
        read_schemas=tuple(re.findall(r"ReadSchema: (.*)", text)),
    )


_SCAN_NODES = ("Project", "Filter", "Relation", "Range", "LocalRelation")


def is_scan(df: DataFrame) -> bool:
    """Whether a table is read from files with at most projections and filters on top."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    nodes = [re.sub(r"^[\s:+\-|]*", "", line) for line in plan.splitlines() if line.strip()]
    return all(node.startswith(_SCAN_NODES) for node in nodes)
