"""Files: reading, converting, inspecting, listing."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.errors import ToolkitError
from rowloom.session import on_hadoop

# Fixed names of formats by file ending.
ENDINGS = {
    "parquet": "parquet",
    "pq": "parquet",
    "csv": "csv",
    "jsonl": "jsonl",
    "ndjson": "jsonl",
    "json": "json",
    "orc": "orc",
}
READ_FORMATS = ("parquet", "csv", "json", "jsonl", "orc")
WRITE_FORMATS = ("parquet", "csv", "json", "jsonl", "orc")


def format_of(path: str) -> str:
    """The format a path's ending stands for."""
    ending = path.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[-1].lower()
    if ending not in ENDINGS:
        raise ToolkitError(f"cannot tell the format of {path!r}; known endings: {sorted(ENDINGS)}")
    return ENDINGS[ending]


def read_source(
    spark: SparkSession,
    path: str,
    fmt: str = "auto",
    schema: T.StructType | str | None = None,
    multi_line: bool = False,
) -> DataFrame:
    """A lazy table over a file or folder.

    ``json`` is one document per file, an array or an object; ``jsonl`` one object per line and
    splittable, so the form for large data. CSV has a header and doubles quotes inside quotes;
    ``multi_line`` allows line breaks in its fields, at the price of one task per file. Give a
    schema for CSV and JSON where it is known: finding one costs a pass over the data.
    """
    kind = format_of(path) if fmt == "auto" else fmt
    if kind not in READ_FORMATS:
        raise ToolkitError(f"unknown format {kind!r}; known: {list(READ_FORMATS)}")
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if kind == "csv":
        reader = reader.option("header", True).option("escape", '"').option("multiLine", multi_line)
        return (reader if schema is not None else reader.option("inferSchema", True)).csv(path)
    if kind == "json":
        return reader.option("multiLine", True).json(path)
    if kind == "jsonl":
        return reader.json(path)
    return reader.format(kind).load(path)


def write_table(df: DataFrame, path: str, fmt: str, mode: str = "errorifexists") -> str:
    """Write a folder of files. JSON is written one object per line; nested values in CSV as JSON text."""
    if fmt not in WRITE_FORMATS:
        raise ToolkitError(f"unknown format {fmt!r}; known: {list(WRITE_FORMATS)}")
    if fmt == "csv":
        nested = (T.ArrayType, T.MapType, T.StructType, T.VariantType)
        texts = {f.name: F.to_json(f"`{f.name}`") for f in df.schema.fields if isinstance(f.dataType, nested)}
        # an escaped quote is a doubled quote, as other CSV readers expect
        df.withColumns(texts).write.mode(mode).option("header", True).option("escape", '"').csv(path)
    elif fmt in ("json", "jsonl"):
        df.write.mode(mode).option("ignoreNullFields", False).json(path)
    else:
        df.write.mode(mode).format(fmt).save(path)
    return path


def convert_format(
    spark: SparkSession,
    source: str,
    target: str,
    in_fmt: str = "auto",
    out_fmt: str = "auto",
    schema: T.StructType | str | None = None,
    mode: str = "errorifexists",
) -> str:
    """Rewrite a file or folder in another format; any pair of formats."""
    kind = format_of(target) if out_fmt == "auto" else out_fmt
    return write_table(read_source(spark, source, in_fmt, schema), target, kind, mode)


def _listing(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, modificationTime, length) of the files below a path; contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select("path", "modificationTime", "length")


def file_inventory(spark: SparkSession, path: str, prefix: str | None = None, glob: str | None = None) -> DataFrame:
    """(key, size, last_modified) of all files below a path; hidden ones are left out, as in any scan."""
    files = _listing(spark, path, glob).select(
        F.col("path").alias("key"), F.col("length").alias("size"), F.col("modificationTime").alias("last_modified")
    )
    if prefix is None:
        return files
    name = F.regexp_extract("key", r"([^/]*)$", 1)
    return files.filter(name.startswith(prefix))


def folder_totals(inventory: DataFrame) -> DataFrame:
    """(folder, files, bytes) of an inventory."""
    return inventory.groupBy(F.regexp_extract("key", r"^(.*)/", 1).alias("folder")).agg(
        F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes")
    )


def entry_totals(spark: SparkSession, inventory: DataFrame, path: str) -> DataFrame:
    """(entry, files, bytes) of an inventory of ``path``: what lies in it directly, a folder with all files below it."""
    root = on_hadoop(spark, path, "makeQualified").toString().rstrip("/")
    below = F.expr(f"substring(key, {len(root) + 2})")
    return inventory.groupBy(F.substring_index(below, "/", 1).alias("entry")).agg(
        F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes")
    )


_FOOTER = "path string, rows bigint, row_groups int, columns int, created_by string"


def _read_footers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Footers of the listed files; the one place where Python runs inside a task."""
    import pyarrow.fs as fs
    import pyarrow.parquet as pq

    for batch in batches:
        found = []
        for path in batch["path"]:
            uri = path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file:///") else path
            system, inner = fs.FileSystem.from_uri(uri)
            with system.open_input_file(inner) as handle:
                meta = pq.ParquetFile(handle).metadata
            found.append((path, meta.num_rows, meta.num_row_groups, meta.num_columns, meta.created_by))
        yield pd.DataFrame(found, columns=["path", "rows", "row_groups", "columns", "created_by"])


def parquet_footers(spark: SparkSession, path: str) -> DataFrame:
    """(path, rows, row_groups, columns, created_by) per Parquet file, footers read in parallel."""
    files = _listing(spark, path, "*.parquet").select("path")
    return files.repartition("path").mapInPandas(_read_footers, _FOOTER)


def parquet_schema(spark: SparkSession, path: str) -> DataFrame:
    """(position, name, type, nullable) of a Parquet table."""
    fields = spark.read.parquet(path).schema.fields
    rows = [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(fields)]
    return spark.createDataFrame(rows, "position int, name string, type string, nullable boolean")


def inspect_parquet(spark: SparkSession, path: str, sample_rows: int = 20) -> dict[str, DataFrame]:
    """Schema, totals (files, rows, row groups) and first rows of a Parquet table."""
    totals = parquet_footers(spark, path).agg(
        F.count(F.lit(1)).alias("files"), F.sum("rows").alias("rows"), F.sum("row_groups").alias("row_groups")
    )
    return {"schema": parquet_schema(spark, path), "totals": totals, "sample": spark.read.parquet(path).limit(sample_rows)}
