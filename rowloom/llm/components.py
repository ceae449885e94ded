"""Connected components of a graph given as edges, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.session import discard, scratch_path


def _written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def _stars(pairs: DataFrame) -> DataFrame:
    """``u``, its neighbour ``v`` and the smallest node among both ``u`` and all of its neighbours, ``m``."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def connected_components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """``node`` and ``root`` (the smallest node of its component) for every node other than a root itself.

    Edges may repeat, loop and point either way; edges with a null end count for nothing. Each round is written
    to the shared folder, so neither the plan nor a lost executor's work grows with the rounds. Only the number
    of edges and a checksum reach the driver. A node of any degree is fine: its edges are reduced to a minimum in
    the tasks that read them, and the join that hands it out can be split by Spark.
    """
    spark = edges.sparkSession
    current, path = _written(
        edges.where(F.col(left) != F.col(right))
        .select(F.greatest(left, right).alias("large"), F.least(left, right).alias("small"))
        .distinct(),
        "edges",
    )
    seen = None
    while True:
        state = current.agg(F.count("*"), F.bit_xor(F.xxhash64("large", "small"))).first()
        if state[0] == 0 or state == seen:
            return current.select(F.col("large").alias("node"), F.col("small").alias("root"))
        seen = state
        both = current.select(F.col("large").alias("u"), F.col("small").alias("v")).union(
            current.select(F.col("small").alias("u"), F.col("large").alias("v"))
        )
        large = _stars(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large, middle = _written(large, "large-star")
        small = _stars(large)
        small = small.where("v <> m").select(F.col("v").alias("large"), F.col("m").alias("small")).union(
            small.select(F.col("u").alias("large"), F.col("m").alias("small"))
        )
        before = path
        current, path = _written(small.where("large <> small").distinct(), "small-star")
        discard(spark, before, middle)
