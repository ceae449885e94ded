"""Read-only SQL over named sources."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from rowloom.errors import ReadOnlyError, ToolkitError
from rowloom.sources.files import read_source

# Fixed list of statements that write.
WRITE_WORDS = ("DROP", "INSERT", "UPDATE", "DELETE", "ALTER", "CREATE", "TRUNCATE", "GRANT", "REVOKE")
_QUOTED = re.compile(
    r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.|\"\")*\"|`(?:[^`]|``)*`|--[^\n]*|/\*.*?\*/", re.DOTALL
)
_REFLECTION = re.compile(r"(?<!\w)(reflect|try_reflect|java_method)\s*\(", re.IGNORECASE)
_START = re.compile(r"(EXPLAIN\s+)?(SELECT|WITH)\b", re.IGNORECASE)


def read_only(sql: str) -> str:
    """The stripped SQL text if it is one read-only statement, else an error.

    Literals, quoted names and comments are left out of the test. Words are told apart by any white
    space or sign, so a write word followed by a line break or a bracket is found as well. Functions
    that run code by reflection are refused.
    """
    stripped = sql.strip()
    text = _QUOTED.sub(lambda m: " " if m[0][:2] in ("--", "/*") else " '' ", stripped).strip()
    if ";" in text:
        raise ReadOnlyError("only one statement is allowed (semicolon found)")
    for word in WRITE_WORDS:
        if re.search(rf"(?<![\w.`\"]){word}(?![\w`\"])", text, re.IGNORECASE):
            raise ReadOnlyError(f"write keyword not allowed: {word}")
    if _REFLECTION.search(text):
        raise ReadOnlyError("functions that run code by reflection are not allowed")
    if not _START.match(text.lstrip(" \t\r\n(")):
        raise ReadOnlyError("a query starts with SELECT, WITH, EXPLAIN SELECT or EXPLAIN WITH")
    return stripped


def register_sources(spark: SparkSession, sources: Mapping[str, DataFrame | str]) -> list[str]:
    """Make each DataFrame or path a temporary view; a later name replaces an earlier one."""
    for name, source in sources.items():
        if not re.fullmatch(r"[A-Za-z_]\w*", name):
            raise ToolkitError(f"not a usable view name: {name!r}")
        df = read_source(spark, source) if isinstance(source, str) else source
        df.createOrReplaceTempView(name)
    return list(sources)


def sql_query(
    spark: SparkSession,
    sql: str,
    sources: Mapping[str, DataFrame | str] | None = None,
    args: Mapping[str, Any] | Sequence[Any] | None = None,
    max_rows: int | None = None,
) -> DataFrame:
    """Run one read-only query over named sources and tables of the session.

    ``args`` fills named (``:name``) or positional (``?``) parameters. ``max_rows`` limits inside
    the plan. The sources are visible to this query only: their views are dropped, and any view
    they hid comes back, once the query is analyzed.
    """
    text = read_only(sql)
    names = list(sources or {})
    hidden = {n: spark.table(n) for n in names if _is_temp_view(spark, n)}
    try:
        register_sources(spark, sources or {})
        # a mapping fills named parameters, a list positional ones
        filled = None if args is None else dict(args) if isinstance(args, Mapping) else list(args)
        result = spark.sql(text) if filled is None else spark.sql(text, args=filled)
    except AnalysisException as error:
        if error.getCondition() == "TABLE_OR_VIEW_NOT_FOUND":
            raise ToolkitError(f"unknown table; available sources: {names}. {error.getMessage()}") from error
        raise
    finally:
        for name in names:
            spark.catalog.dropTempView(name)
        for name, df in hidden.items():
            df.createOrReplaceTempView(name)
    return result if max_rows is None else result.limit(max_rows)


def _is_temp_view(spark: SparkSession, name: str) -> bool:
    return any(t.isTemporary and t.name.lower() == name.lower() for t in spark.catalog.listTables(pattern=name))


def explain_query(
    spark: SparkSession, sql: str, sources: Mapping[str, DataFrame | str] | None = None, mode: str = "FORMATTED"
) -> DataFrame:
    """The plan of a read-only query as rows of one text column ``plan``."""
    if mode.upper() not in ("FORMATTED", "EXTENDED", "COST", "CODEGEN", "SIMPLE"):
        raise ToolkitError(f"unknown explain mode {mode!r}")
    text = re.sub(r"(?i)^EXPLAIN\s+", "", read_only(sql))
    shown = "" if mode.upper() == "SIMPLE" else mode.upper()
    names = list(sources or {})
    hidden = {n: spark.table(n) for n in names if _is_temp_view(spark, n)}
    try:
        register_sources(spark, sources or {})
        return spark.sql(f"EXPLAIN {shown} {text}")
    finally:
        for name in names:
            spark.catalog.dropTempView(name)
        for name, df in hidden.items():
            df.createOrReplaceTempView(name)
