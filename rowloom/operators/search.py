"""Regular-expression search in the lines of texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowloom.functions.columns import as_list, col, require


def search_text(df: DataFrame, text_col: str, pattern: str, id_cols: str | Sequence[str]) -> DataFrame:
    """(ids..., line_number, line) for every line with a match; lines count from 1 and are stripped."""
    require(df, text_col)
    ids = require(df, as_list(id_cols))
    lines = df.select(*[col(i) for i in ids], F.posexplode(F.split(col(text_col), "\n")).alias("__at", "__line"))
    return lines.filter(F.col("__line").rlike(pattern)).select(
        *[col(i) for i in ids],
        (F.col("__at") + 1).alias("line_number"),
        F.regexp_replace("__line", r"^\s+|\s+$", "").alias("line"),
    )


def match_counts(matches: DataFrame, id_cols: str | Sequence[str]) -> DataFrame:
    """(ids..., n) from the result of :func:`search_text`."""
    return matches.groupBy(*[col(i) for i in require(matches, as_list(id_cols))]).agg(F.count(F.lit(1)).alias("n"))


def search_files(spark: SparkSession, path: str, pattern: str, glob: str | None = None) -> DataFrame:
    """(path, line_number, line) for every matching line of the text files below a folder.

    Large files are split over tasks: a line's number is its place in its split after all lines of
    the splits before. That takes a pass which counts the lines; only counts are shuffled.
    """
    reader = spark.read.option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    lines = reader.text(path).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("at"),
        "value",
    )
    splits = lines.groupBy("path", "start").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select(
        F.col("path").alias("p"), F.col("start").alias("s"), "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")
    )
    found = lines.filter(F.col("value").rlike(pattern))
    return found.join(splits, (F.col("path") == F.col("p")) & (F.col("start") == F.col("s"))).select(
        "path", (F.col("at") - F.col("first") + F.col("before") + 1).alias("line_number"), F.trim("value").alias("line")
    )
