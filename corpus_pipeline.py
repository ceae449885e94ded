"""From raw documents to token files: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rowloom.llm import catalog, decontaminate, langid, mixing, nearcopies, sequences
from rowloom.session import discard, scratch_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised stay."""
    return langid.accepted(docs, catalog.language_model(docs), "text")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (Jaccard 0.8 on five words) stays: the one with the smallest id.

    The multi-index search proposes the closest copies, MinHash bands the others, down to 0.8.
    """
    return nearcopies.one_of_each(docs, "doc_id", "text")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that quote too much of the benchmark go."""
    return decontaminate.clean_rows(docs, "text", catalog.table(spark, sf_dir, "benchmark"), "item_id", "text")


def mixing_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: never, once or twice."""
    return mixing.mixed_rows(docs, "doc_id", "text", "source")


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str, output: str | None = None) -> DataFrame:
    """Ids of what is left, in Arrow files; a row per document as read back from them."""
    return sequences.encode_to_files(docs, "doc_id", "text", catalog.vocabulary(), folder=output)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("mixing_to_target_weights", mixing_to_targets),
    ("token_id_output", token_files),
]

# Neither the classifier nor the tokenizer can be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, output: str | None = None) -> DataFrame:
    """All stages over ``documents``; what each returns is written and read again, and what it read is deleted.

    The token files and their manifest stay in the folder ``output`` if one is given.
    """
    docs, before = catalog.table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        kept = stage(spark, docs, sf_dir)
        path = scratch_path(spark, name)
        kept.write.parquet(path)
        docs = spark.read.schema(kept.schema).parquet(path)
        discard(spark, *before)
        before = [path]
    found = token_files(spark, docs, sf_dir, output)
    discard(spark, *before)
    return found
