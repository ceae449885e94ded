"""Column profiles from sketches that are kept per file and merged, so that appended data costs one scan of new files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.errors import ToolkitError
from rowloom.functions.columns import as_text, col, is_numeric, present, require, type_of
from rowloom.operators.aggregate import QUANTILES, _quantile_name, quantiles_in_bands

# Size of the quantile sketch, and the rank error that it stays below at any number of values (99 %).
KLL_SIZE = 1000
RANK_ERROR = 0.005
# log2 of the registers of the distinct-count sketch; its relative error is about 1.04 / sqrt(registers).
HLL_BITS = 12
DISTINCT_ERROR = 1.04 / 2 ** (HLL_BITS / 2)

_FILE = ("path", "modified", "length")
_KINDS = {"string": T.StringType(), "timestamp": T.TimestampType(), "long": T.LongType(), "double": T.DoubleType(), "binary": T.BinaryType()}
_STATE = (
    "path string, modified timestamp, length long, column string, dtype string, n_rows long, present long, mean double, m2 double,"
    " low double, high double, low_text string, high_text string, distinct binary, quantiles binary"
)
STATE = T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in (field.split() for field in _STATE.split(","))])


def data_files(spark: SparkSession, path: str) -> DataFrame:
    """``path``, ``modified`` and ``length`` of the Parquet files of a folder; contents are not read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    return listed.select("path", F.col("modificationTime").alias("modified"), "length")


def file_states(df: DataFrame, columns: Sequence[str], file: Column) -> DataFrame:
    """One row per file and column with counts, moments, bounds and sketches; one scan, reduced where it is read."""
    aggs: list[Column] = [F.count(F.lit(1)).alias("n_rows")]
    cells = []
    for i, name in enumerate(columns):
        dtype, value = type_of(df, name), present(df, name)
        number = value.cast("double") if is_numeric(dtype) else F.lit(None).cast("double")
        text = F.lit(None).cast("string") if is_numeric(dtype) else as_text(df, name)
        # equal values have equal hashes; both zeros are one value
        whole = isinstance(dtype, T.IntegralType)
        hashed = F.xxhash64(value.cast("bigint") if whole else number + 0.0 if is_numeric(dtype) else text)
        there = value.isNotNull()
        aggs += [
            F.count(value).alias(f"present{i}"),
            F.avg(number).alias(f"mean{i}"),
            (F.var_pop(number) * F.count(number)).alias(f"m2{i}"),
            F.min(number).alias(f"low{i}"),
            F.max(number).alias(f"high{i}"),
            F.min(text).alias(f"low_text{i}"),
            F.max(text).alias(f"high_text{i}"),
            F.hll_sketch_agg(F.when(there, hashed), HLL_BITS).alias(f"distinct{i}"),
            F.kll_sketch_agg_double(number, KLL_SIZE).alias(f"quantiles{i}"),
        ]
        own = [f.name for f in STATE.fields[6:]]
        named = [F.lit(name).alias("column"), F.lit(dtype.simpleString()).alias("dtype"), F.col("n_rows")]
        cells.append(F.struct(*named, *[col(f"{c}{i}").alias(c) for c in own]))
    return df.groupBy(file.alias("path")).agg(*aggs).select("path", F.inline(F.array(*cells)))


def refresh_sketches(spark: SparkSession, path: str, store: str, columns: str | Sequence[str] | None = None) -> int:
    """Sketch the files of a Parquet folder that the store does not know yet, and return their number.

    A file is known by its path, time and length; one that was written anew is sketched anew. The store is a Parquet
    folder with a row per file and column. All columns are sketched unless some are named; a store keeps to its columns.
    """
    files = data_files(spark, path)
    try:
        known = spark.read.schema(STATE).parquet(store)
        fresh = files.join(known.select(*_FILE).distinct(), list(_FILE), "left_anti")
        stored = known.select("column").where("column IS NOT NULL").distinct().orderBy("column").collect()
        columns = columns or [r["column"] for r in stored] or None
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        fresh = files
    found = fresh.collect()  # names only, as Spark needs them to read the files
    if not found:
        return 0
    data = spark.read.parquet(*[r["path"] for r in found])
    names = require(data, columns) if columns is not None else data.columns
    states = file_states(data, names, F.col("_metadata.file_path"))
    listed = spark.createDataFrame([(r["path"], r["modified"], r["length"]) for r in found], T.StructType(STATE.fields[:3]))
    # a file without rows has no state of its own; it is known by an empty one
    rows = listed.join(states, "path", "left").select(*[F.col(f.name).cast(f.dataType) for f in STATE.fields])
    rows.write.mode("append").parquet(store)
    return len(found)


def _states(spark: SparkSession, path: str, store: str) -> DataFrame:
    """The states of the files that the folder holds now, each once."""
    current = data_files(spark, path)
    return spark.read.schema(STATE).parquet(store).dropDuplicates([*_FILE, "column"]).join(current, list(_FILE)).where("column IS NOT NULL")


def _merged(states: DataFrame) -> DataFrame:
    """One row per column with merged sketches; a file without rows adds nothing."""
    # spread about the mean: that inside the files and that between them
    total = F.sum(F.col("mean") * F.col("present")) / F.nullifzero(F.sum(F.when(F.col("mean").isNotNull(), F.col("present"))))
    between = F.sum(F.col("present") * F.col("mean") * F.col("mean"))
    n = F.sum(F.when(F.col("mean").isNotNull(), F.col("present")))
    return states.groupBy("column").agg(
        F.max("dtype").alias("dtype"),
        F.sum("n_rows").alias("n_rows"),
        F.sum("present").alias("present"),
        total.alias("mean"),
        (F.sum("m2") + between - n * total * total).alias("m2"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        F.min("low_text").alias("low_text"),
        F.max("high_text").alias("high_text"),
        F.hll_sketch_estimate(F.hll_union_agg("distinct")).alias("distinct"),
        F.kll_merge_agg_double("quantiles", KLL_SIZE).alias("sketch"),
    )


def _at(q: float) -> Column:
    return F.when(F.col("low").isNotNull(), F.kll_sketch_get_quantile_double("sketch", F.lit(float(min(1.0, max(0.0, q))))))


def sketched_profile(spark: SparkSession, path: str, store: str, quantiles: Sequence[float] = QUANTILES) -> DataFrame:
    """One row per column: rows, missing values, bounds, mean, deviation, distinct values and quantiles, without a scan.

    Counts, bounds and moments are exact; ``distinct_estimate`` is off by about :data:`DISTINCT_ERROR`, the rank of a
    quantile by :data:`RANK_ERROR` at most. Bounds are texts. Numbers of the files that the folder holds now are merged;
    files unknown to the store (see :func:`refresh_sketches`) are not in it.
    """
    text = F.coalesce(F.col("low").cast("string"), F.col("low_text")), F.coalesce(F.col("high").cast("string"), F.col("high_text"))
    return _merged(_states(spark, path, store)).select(
        "column",
        "dtype",
        "n_rows",
        (F.col("n_rows") - F.col("present")).alias("missing"),
        text[0].alias("minimum"),
        text[1].alias("maximum"),
        "mean",
        F.when(F.col("present") > 1, F.sqrt(F.greatest(F.col("m2"), F.lit(0.0)) / (F.col("present") - 1))).alias("std"),
        F.col("distinct").alias("distinct_estimate"),
        *[_at(q).alias(_quantile_name(q)) for q in quantiles],
    )


def exact_quantiles_from(
    spark: SparkSession, path: str, store: str, columns: str | Sequence[str], quantiles: Sequence[float] = QUANTILES
) -> DataFrame:
    """(column, q, value): exact quantiles in one pass over the data, between bounds that the stored sketches give.

    Files that the store does not know are sketched first. A bound that misses is an error, never a wrong number.
    """
    refresh_sketches(spark, path, store)
    data = spark.read.parquet(path)
    names = require(data, columns)
    for name in names:
        if not is_numeric(type_of(data, name)):
            raise ToolkitError(f"column {name!r} is not a number")
    slack = 2 * RANK_ERROR
    place = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("column"))
    # a short column is its own band: there, one rank may be more than the slack
    short = F.col("present") <= 1 / RANK_ERROR
    rows = [
        F.struct(
            (place - 1).cast("int").alias("at"),
            F.lit(float(q)).alias("q"),
            F.when(short | F.lit(q <= slack), F.col("low")).otherwise(_at(q - slack)).alias("low"),
            F.when(short | F.lit(q >= 1 - slack), F.col("high")).otherwise(_at(q + slack)).alias("high"),
            (F.lit(float(q)) * (F.col("present") - 1)).alias("position"),
        )
        for q in quantiles
    ]
    bands = _merged(_states(spark, path, store)).where(place > 0).select(F.inline(F.array(*rows)))
    # merging draws lots: a row per column and quantile, computed once
    return quantiles_in_bands(data, names, spark.createDataFrame(bands.collect(), bands.schema))
