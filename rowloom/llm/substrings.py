"""Removal of repeated word passages, found through difference-cover anchors.

A window of 35 words is repeated if its words also start anywhere else. Hashing every window of every document would
shuffle a row per word. Instead, *anchors* of 15 words are hashed only where the place modulo 21 lies in the
difference cover {0, 1, 4, 14, 16}: for any two places some shift below 21 takes both into the cover, so two equal
windows share an anchor at equal distance from their starts, 35 - 21 + 1 = 15 words long. Only windows around an
anchor that occurs twice are then extended to their full length, hashed with 96 bits and compared.

Before any shuffle, equal hashes are reduced to one per slice of a task, so a passage that a third of the corpus
repeats is a row per slice, not per place. Documents are written once, as compressed words with a row number that
stays; what is found returns to them by that number.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowloom.llm.slices import map_slices
from rowloom.session import discard, scratch_path

WINDOW = 35
PERIOD = 21
COVER = (0, 1, 4, 14, 16)
ANCHOR = WINDOW - PERIOD + 1
# Windows are compared by 96 bits of a hash, in two parts.
HASH_BITS = np.array([(1 << 64) - 1, (1 << 32) - 1], np.uint64)


def joined_words(text: str | None) -> bytes:
    """The words between ASCII blanks, one blank between them."""
    return b" ".join((text or "").encode("utf-8", "replace").split())


def word_bounds(words: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word starts and ends."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    blanks = np.flatnonzero(np.frombuffer(words, np.uint8) == 32)
    return np.concatenate([[0], blanks + 1]), np.concatenate([blanks, [len(words)]])


def cover_places(n_words: int) -> np.ndarray:
    """Places of the anchors of a document; none if it has no window."""
    if n_words < WINDOW:
        return np.zeros(0, np.int64)
    places = (np.arange(0, n_words, PERIOD)[:, None] + np.array(COVER)).ravel()
    return places[places <= n_words - ANCHOR]


def candidate_windows(anchors: np.ndarray, n_words: int) -> np.ndarray:
    """Starts of the windows that hold one of the anchors."""
    change = np.zeros(n_words + 2, np.int64)
    np.add.at(change, np.maximum(anchors - PERIOD + 1, 0), 1)
    np.add.at(change, anchors + 1, -1)
    starts = np.flatnonzero(np.cumsum(change)[: n_words - WINDOW + 1])
    return starts


def covered_words(starts: np.ndarray, n_words: int) -> np.ndarray:
    """Which words lie in a window that begins at one of the starts."""
    change = np.zeros(n_words + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + WINDOW, -1)
    return np.cumsum(change)[:n_words] > 0


def _written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def _release(spark: SparkSession) -> None:
    """Let the driver notice that the shuffle files of finished steps are of no use any more."""
    spark.sparkContext._jvm.System.gc()


def _prepared(df: DataFrame, key: str, text: str) -> DataFrame:
    kind = df.select(F.col(key).alias("key")).schema
    kind = kind.add("n_words", "long").add("sha", "string").add("packed", "binary")

    def start():
        pack = zstandard.ZstdCompressor(level=3).compress

        def work(part):
            words = [joined_words(x) for x in part.column(1).to_pylist()]
            return {
                "key": part.column(0),
                "n_words": [w.count(b" ") + 1 if w else 0 for w in words],
                "sha": [sha256(w).hexdigest() for w in words],
                "packed": [pack(w) for w in words],
            }

        return work

    found = map_slices(df.select(F.col(key).alias("key"), F.col(text).alias("__text")), kind, start, "__text")
    return found.withColumn("row", F.monotonically_increasing_id())


def _once_per_slice(hashes: np.ndarray, rows: np.ndarray, places: np.ndarray) -> dict[str, np.ndarray]:
    """Columns ``h0``, ``h1``, ``row`` and ``place`` of the hashes that other slices may have, each once.

    A place is stored as ``-1 - place`` where the slice itself has the hash more than once. Other places of such a
    hash go under a hash of their own, as nothing else need be known about them.
    """
    order = np.lexsort((hashes[:, 1], hashes[:, 0]))
    sorted_hashes = hashes[order]
    first = np.ones(len(order), bool)
    first[1:] = (sorted_hashes[1:] != sorted_hashes[:-1]).any(axis=1)
    group = np.cumsum(first) - 1
    many = (np.bincount(group)[group] > 1) if len(order) else np.zeros(0, bool)
    rows, places = rows[order], places[order]
    own = many & ~first
    row, place = rows[own].astype(np.uint64), places[own].astype(np.uint64)
    sorted_hashes[own, 0] = row * np.uint64(0x9E3779B97F4A7C15) + place * np.uint64(0x632BE59BD9B4E019)
    sorted_hashes[own, 1] = (row ^ (place << np.uint64(9))) & HASH_BITS[1]
    return {
        "h0": sorted_hashes[:, 0].view(np.int64),
        "h1": sorted_hashes[:, 1].astype(np.uint32).view(np.int32),
        "row": rows,
        "place": np.where(many, -1 - places, places).astype(np.int32),
    }


def _hashed(df: DataFrame, extra: str | None, wide: bool) -> DataFrame:
    """Hashes of a table's anchors (all documents) or of its candidate windows (those around ``extra``'s anchors)."""
    kind = ("h0 long, h1 int, " if wide else "h0 long, ") + "row long, place int"

    def start():
        unpack = zstandard.ZstdDecompressor().decompress

        def work(part):
            found, rows, places = [], [], []
            packed, numbers = part.column("packed").to_pylist(), part.column("row").to_pylist()
            marks = part.column(extra) if extra else None
            for i, (body, row) in enumerate(zip(packed, numbers, strict=True)):
                words = unpack(body)
                starts, ends = word_bounds(words)
                if extra:
                    at, length = candidate_windows(marks[i].values.to_numpy().astype(np.int64), len(starts)), WINDOW
                else:
                    at, length = cover_places(len(starts)), ANCHOR
                if not len(at):
                    continue
                cut = zip(starts[at].tolist(), ends[at + length - 1].tolist(), strict=True)
                if wide:
                    digest = xxhash.xxh3_128_digest
                    wide_hashes = np.frombuffer(b"".join([digest(words[a:b]) for a, b in cut]), "<u8").reshape(-1, 2)
                    found.append(wide_hashes & HASH_BITS)
                else:
                    digest = xxhash.xxh3_64_intdigest
                    short = np.fromiter([digest(words[a:b]) for a, b in cut], np.uint64, len(at))
                    found.append(np.stack([short, np.zeros_like(short)], axis=1))
                rows.append(np.full(len(at), row, np.int64))
                places.append(at)
            if not found:
                empty = np.zeros(0, np.int64)
                return {"h0": empty, "h1": empty, "row": empty, "place": empty}
            out = _once_per_slice(np.concatenate(found), np.concatenate(rows), np.concatenate(places))
            return out

        return work

    return map_slices(df, kind, start, "packed")


def _repeated(hashed: DataFrame, wide: bool) -> DataFrame:
    """``row`` and the list ``places`` where its hashes occur more than once."""
    same = Window.partitionBy("h0", "h1") if wide else Window.partitionBy("h0")
    return (
        hashed.withColumn("n", F.count("*").over(same))
        .where("n > 1 OR place < 0")
        .groupBy("row")
        .agg(F.collect_list(F.when(F.col("place") < 0, -1 - F.col("place")).otherwise(F.col("place"))).alias("places"))
    )


def remove_repeats(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, ``n_words``, ``n_removed`` and ``kept`` (words left, None where none is removed), ``kept_sha256``.

    Every row of ``df`` gives one row. Null and blank texts have no words. Repeated rows are places of their own, so
    each loses what it shares with the other; keys may be null or repeat. Windows are judged on the input.
    """
    spark = df.sparkSession
    prepared, prepared_path = _written(_prepared(df, key, text), "words")
    marks, marks_path = _written(_repeated(_hashed(prepared.select("row", "packed"), None, False), False), "anchors")
    _release(spark)
    touched, _ = _written(prepared.select("row", "packed").join(marks, "row"), "candidates")
    whole, _ = _written(prepared.drop("packed"), "documents")
    discard(spark, marks_path, prepared_path)
    _release(spark)
    found, _ = _written(_repeated(_hashed(touched, "places", True), True), "repeats")
    _release(spark)

    def start():
        unpack = zstandard.ZstdDecompressor().decompress

        def work(part):
            removed, kept = [], []
            for i, body in enumerate(part.column("packed").to_pylist()):
                words = unpack(body).split(b" ")
                gone = covered_words(part.column("at")[i].values.to_numpy().astype(np.int64), len(words))
                removed.append(int(gone.sum()))
                kept.append(b" ".join([w for w, out in zip(words, gone.tolist(), strict=True) if not out]))
            return {
                "row": part.column("row"),
                "n_removed": removed,
                "kept": pa.array([k.decode() for k in kept], pa.string()),
                "kept_sha": [sha256(k).hexdigest() for k in kept],
            }

        return work

    cut = map_slices(
        touched.select("row", "packed").join(found.select("row", F.col("places").alias("at")), "row"),
        "row long, n_removed long, kept string, kept_sha string",
        start,
        "packed",
    )
    return whole.join(cut, "row", "left").select(
        F.col("key").alias(key),
        "n_words",
        F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        "kept",
        F.coalesce("kept_sha", "sha").alias("kept_sha256"),
    )
