"""Exact top-k search by inner product with MaxScore over shards.

A vector is a document whose terms are its dimensions; a shard keeps one posting list per dimension, with the largest
and the smallest value in it. These bound what a term can add to a query's score. Per query and shard, terms are
ordered by bound. Those at the low end whose bounds together cannot lift a candidate over the threshold are
non-essential: only the posting lists of the others are traversed; then the non-essential terms are probed, strongest
first, for the candidates that are still competitive, until few are left. Best lists of the shards are merged.

Dense vectors have a value in nearly every list, so a list is a full column of its shard. Shards and query blocks have
a bounded number of rows; each pair of them is one row of work. So nothing is broadcast and no task sees a whole side.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from rowloom.session import materialize

SCALE = 256
K = 5
SHARD_ROWS = 4096
QUERY_ROWS = 1024
# Components that fit in 32 bits are stored so; blocks with larger ones keep their numbers as doubles.
NARROW = 1 << 31
# Scores that may leave 64 bits are summed in Python's integers.
EXACT = 1 << 62
LONG = (1 << 63) - 1
# Documents that are scored between two looks at the threshold.
STRIDE = 1024

# Each join partner of a query block is named under one of so many salts.
SALTS = 64

_PACKED = "block string, rows int, dims int, ids binary, places binary, data binary, wide boolean"


def usable(vector: Column) -> Column:
    """Not null, and every component a finite number."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False))


def whole(numbers: np.ndarray) -> np.ndarray:
    """floor(256 * x) of every component: 64-bit integers, or Python's where one is too large for them."""
    if not numbers.size or np.abs(numbers).max() < EXACT / SCALE:
        return np.floor(SCALE * numbers).astype(np.int64)
    # beyond 2**53 a double is an integer itself
    exact = [int(x) * SCALE if abs(x) >= 1 << 53 else math.floor(SCALE * x) for x in numbers.ravel().tolist()]
    return np.array(exact, object).reshape(numbers.shape)


def packed(vectors: list[list[float]]) -> tuple[bytes, int, bool]:
    """Components as 32-bit integers, or as doubles where one does not fit; shorter vectors are filled with zeros."""
    dims = max((len(v) for v in vectors), default=0)
    found = np.zeros((len(vectors), dims))
    for row, v in zip(found, vectors, strict=True):
        row[: len(v)] = v
    wide = bool(found.size and np.abs(found).max() >= NARROW / SCALE)
    return (found.astype("<f8") if wide else whole(found).astype("<i4")).tobytes(), dims, wide


def unpacked(data: bytes, rows: int, dims: int, wide: bool) -> np.ndarray:
    if wide:
        return whole(np.frombuffer(data, "<f8").reshape(rows, dims))
    return np.frombuffer(data, "<i4").reshape(rows, dims).astype(np.int64)


def sortable(score: int) -> bytes:
    """Bytes that are in the order of the integers: sign and length first, then the digits."""
    size = (abs(score).bit_length() + 7) // 8
    digits = abs(score).to_bytes(size, "big")
    if score < 0:
        return (0x8000 - size).to_bytes(2, "big") + bytes(255 - d for d in digits)
    return (0x8000 + size).to_bytes(2, "big") + digits


def _pack(df: DataFrame, rows: int) -> DataFrame:
    """Rows (``id``, ``vector``) in blocks of up to ``rows``, each block one row; every input row has a number of its own."""
    kind = StructType.fromDDL(_PACKED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = to_arrow_schema(kind)
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                data, dims, wide = packed(part.column("vector").to_pylist())
                # Null ids come after all others; the mark is the largest long.
                ids = np.array([LONG if x is None else x for x in part.column("id").to_pylist()], np.int64)
                row = [uuid.uuid4().hex, len(ids), dims, ids.tobytes(), b"", data, wide]
                yield pa.record_batch([pa.array([x], f.type) for x, f in zip(row, target, strict=True)], schema=target)

    return df.mapInArrow(run, kind)


def _queries(shards: DataFrame, every: int, rows: int) -> DataFrame:
    """The shards' rows whose id ``every`` divides, in blocks, with their place in their shard."""
    kind = StructType.fromDDL(_PACKED + ", shard string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = to_arrow_schema(kind)
        for batch in batches:
            for r in batch.to_pylist():
                ids = np.frombuffer(r["ids"], np.int64)
                data = np.frombuffer(r["data"], "<f8" if r["wide"] else "<i4").reshape(r["rows"], r["dims"])
                asked = np.flatnonzero((ids % every == 0) & (ids != LONG))
                for at in range(0, len(asked), rows):
                    some = asked[at : at + rows]
                    row = [
                        f"{r['block']}-{at}", len(some), r["dims"], ids[some].tobytes(),
                        some.astype(np.int64).tobytes(), data[some].tobytes(), r["wide"], r["block"],
                    ]
                    yield pa.record_batch([pa.array([x], f.type) for x, f in zip(row, target, strict=True)], schema=target)

    return shards.mapInArrow(run, kind)


def ranked(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray | list[int]:
    """Places of the ``k`` best scores, smaller id first among equals."""
    if scores.dtype != object:
        return np.lexsort((ids, -scores))[:k]
    return sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k]


class Shard:
    """Posting lists of a block of vectors, by dimension."""

    def __init__(self, ids: np.ndarray, data: np.ndarray):
        self.ids = ids
        self.lists = np.ascontiguousarray(data.T)
        self.most = self.lists.max(axis=1) if data.size else np.zeros(data.shape[1], np.int64)
        self.least = self.lists.min(axis=1) if data.size else np.zeros(data.shape[1], np.int64)
        self.largest = max(map(abs, [*self.most.tolist(), *self.least.tolist()]), default=0)

    def exact(self) -> Shard:
        """The same lists in Python's integers."""
        return Shard(self.ids, self.lists.T.astype(object))

    def top(self, query: np.ndarray, k: int, own: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Positions and scores of the ``k`` best, smaller id first among equals; the row ``own`` takes no part."""
        dims = min(len(query), len(self.lists))
        query = query[:dims]
        if self.lists.dtype != object and dims * self.largest * max(map(abs, query.tolist()), default=0) >= EXACT:
            return self.exact().top(query, k, own)
        bound = np.maximum(query * self.most[:dims], query * self.least[:dims])
        terms = np.argsort(bound, kind="stable")  # weakest first
        together = np.cumsum(bound[terms])  # most that the weakest terms can add
        best = np.zeros(0, np.int64)
        scores = np.zeros(0, np.int64)
        for first in range(0, len(self.ids), STRIDE):
            places = np.arange(first, min(first + STRIDE, len(self.ids)))
            if first <= own < first + STRIDE:
                places = np.delete(places, own - first)
            threshold = scores[-1] if len(scores) == k else None
            # Terms below ``split`` are non-essential: alone they stay below the threshold.
            split = 0 if threshold is None else int(np.searchsorted(np.maximum.accumulate(together), threshold, "left"))
            essential = terms[split:]
            part = query[essential] @ self.lists[essential, first : first + STRIDE]
            part = part[places - first]
            while split:
                if threshold is not None:
                    open_ = (part + together[split - 1] >= threshold).astype(bool)
                    places, part = places[open_], part[open_]
                if not len(places):
                    break
                step = max(0, split - 8)
                some = terms[step:split]
                part = part + query[some] @ self.lists[some[:, None], places[None, :]]
                split = step
            if not len(places):
                continue
            places, part = np.concatenate([best, places]), np.concatenate([scores, part])
            order = np.array(ranked(part, self.ids[places], k))
            best, scores = places[order], part[order]
        return best, scores


def _search(pairs: DataFrame, k: int) -> DataFrame:
    kind = StructType.fromDDL("asked string, query_id long, vec_id long, score long, place binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, opened, shard = to_arrow_schema(kind), None, None
        for batch in batches:
            for i in range(batch.num_rows):
                r = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
                if opened != r["block"]:
                    data = unpacked(r["data"], r["rows"], r["dims"], r["wide"])
                    shard, opened = Shard(np.frombuffer(r["ids"], np.int64), data), r["block"]
                asked = unpacked(r["q_data"], r["q_rows"], r["q_dims"], r["q_wide"])
                places, names = np.frombuffer(r["q_places"], np.int64), np.frombuffer(r["q_ids"], np.int64)
                of, vecs, scores = [], [], []
                for n, query in enumerate(asked):
                    best, found = shard.top(query, k, int(places[n]) if r["q_shard"] == r["block"] else -1)
                    of += [n] * len(best)
                    vecs.append(shard.ids[best])
                    scores += [int(x) for x in found]
                if of:
                    columns = [
                        pa.array([f"{r['q_shard']}/{places[n]}" for n in of]), pa.array(names[of]),
                        pa.array(np.concatenate(vecs)), pa.array([max(-LONG - 1, min(LONG, x)) for x in scores], pa.int64()),
                        pa.array([sortable(x) for x in scores], pa.binary()),
                    ]
                    yield pa.record_batch(columns, schema=target)

    return pairs.mapInArrow(run, kind)


def nearest(df: DataFrame, key: str, vector: str, every: int, k: int = K, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the ``k`` best candidates of each query.

    Queries are the rows whose key ``every`` divides; candidates are all rows but the query's own (a repeated row is a
    candidate of its twin). Fewer than ``k`` candidates give fewer rows. Null vectors and vectors with a component
    that is null or not finite take no part; a vector without components scores 0, a shorter one as if filled with
    zeros. Rows with a null key are candidates, after all others among equals, and never queries. Finite components of
    any size take part, and scores are exact when ranked; a score beyond 64 bits is shown as the nearest 64-bit number.
    """
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    shards = materialize(_pack(rows.where(usable(F.col("vector"))), shard_rows), "shards")
    asked = materialize(_queries(shards, every, QUERY_ROWS), "queries").select(
        "shard", *(F.col(c).alias(f"q_{c}") for c in ("block", "rows", "dims", "ids", "places", "data", "wide"))
    )
    # Every shard meets every block of queries. Only names are paired, under salts, so no task pairs them all.
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    names = shards.select(F.col("block").alias("to"), F.pmod(F.xxhash64("block"), F.lit(SALTS)).cast("int").alias("salt"))
    named = asked.select("q_block", salts).join(names, "salt").drop("salt")
    pairs = named.join(asked.withColumnRenamed("shard", "q_shard"), "q_block").join(shards, F.col("to") == F.col("block"))
    sides = ["rows", "dims", "ids", "data", "wide"]
    found = _search(pairs.select("block", *sides, "q_shard", "q_places", *(f"q_{c}" for c in sides)), k)
    order = Window.partitionBy("asked").orderBy(F.desc("place"), "vec_id")
    merged = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    absent = F.lit(LONG)
    return merged.select("query_id", "rank", F.nullif("vec_id", absent).alias("vec_id"), "score")
