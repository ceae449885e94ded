"""SimHash near-duplicates by multi-index hashing.

A text's fingerprint has the bits that most hashes of its word shingles have. Two fingerprints within distance 3
agree, in one of their two 32-bit segments, up to a single bit. So the table of segments is probed with the Hamming
ball of radius 1 around each segment, and the complete distance of what is found is verified.

Three things keep groups of copies of any size harmless: equal fingerprints are reduced to one before the search;
fingerprints with one segment in common are kept together in *classes* of bounded size, so that tables meet class by
class and a crowded segment is spread over many rows; and a pair of classes returns only the links that connect its
members (a spanning forest), never all pairs. Components follow from those links.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.llm.components import connected_components
from rowloom.llm.slices import map_slices
from rowloom.session import materialize

SEED = 42
SHINGLE_WORDS = 3
DISTANCE = 3
# Fingerprints of one segment that are compared as one block.
CLASS_ROWS = 1024
# Shingle hashes whose bits are counted at a time.
COUNTED = 1 << 16


def shingle_hashes(text: str | None, words: int = SHINGLE_WORDS) -> np.ndarray:
    """XXH64 of every shingle of the text, repeats included; A-Z are lower-cased first."""
    parts = (text or "").encode("utf-8", "replace").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(parts) - words + 1].tolist()
    digest = xxhash.xxh64_intdigest
    found = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)]
    return np.fromiter(found, np.uint64, len(found))


def fingerprint(hashes: np.ndarray) -> int:
    """Bit by bit, 1 where more than half of the hashes have a 1; zero without hashes. As a signed integer."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), COUNTED):
        part = hashes[at : at + COUNTED]
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key`` and the fingerprint ``fp`` (64 bits as a long) of every row, over its whole text."""
    kind = df.select(key).schema.add("fp", "long")

    def start():
        return lambda part: {
            key: part.column(0),
            "fp": [fingerprint(shingle_hashes(x)) for x in part.column(1).to_pylist()],
        }

    return map_slices(df.select(key, F.col(text).alias("__text")), kind, start, "__text")


def _segments(fps: DataFrame) -> DataFrame:
    """Two rows per fingerprint: segment number and value, and the fingerprint."""
    return fps.select(
        "fp",
        F.posexplode(
            F.array(F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)))
        ).alias("segment", "value"),
    )


def _classes(fps: DataFrame, class_rows: int) -> DataFrame:
    """``segment``, ``value``, ``part`` of ``parts``, and the ``members``: fingerprints with that segment.

    A segment that more than ``class_rows`` fingerprints share is split by hash into as many parts as it needs.
    """
    rows = _segments(fps)
    crowded = (
        rows.groupBy("segment", "value")
        .count()
        .where(F.col("count") > class_rows)
        .select("segment", "value", F.ceil(F.col("count") / class_rows).alias("parts"))
    )
    return (
        rows.join(crowded, ["segment", "value"], "left")
        .withColumn("parts", F.coalesce("parts", F.lit(1)))
        .withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")))
        .groupBy("segment", "value", "parts", "part")
        .agg(F.collect_list("fp").alias("members"))
    )


def _class_pairs(classes: DataFrame) -> DataFrame:
    """``a`` and ``b``: members of the class pairs whose segments are equal or differ in one bit.

    One of two values that differ in a bit has a 0 there, so each ball is enumerated from that side only: a probe
    for every 0 bit, besides the value itself where a class or a segment has several members.
    """
    flips = F.transform(
        F.filter(F.sequence(F.lit(0), F.lit(31)), lambda b: F.call_function("getbit", F.col("value"), b) == 0),
        lambda b: F.col("value") + F.call_function("shiftleft", F.lit(1).cast("bigint"), b),
    )
    own = F.when((F.col("parts") > 1) | (F.size("members") > 1), F.array("value")).otherwise(
        F.array().cast("array<bigint>")
    )
    probes = classes.select(
        "segment",
        F.explode(F.concat(own, flips)).alias("probe"),
        F.col("value").alias("from_value"),
        F.col("part").alias("from_part"),
        F.col("members").alias("a"),
    )
    table = classes.select(
        F.col("segment").alias("t_segment"), F.col("value").alias("t_value"), "part", F.col("members").alias("b")
    )
    met = (F.col("segment") == F.col("t_segment")) & (F.col("probe") == F.col("t_value"))
    once = (F.col("from_value") != F.col("t_value")) | (F.col("from_part") <= F.col("part"))
    return probes.join(table, met & once).select("a", "b")


def forest(a: np.ndarray, b: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between members of ``a`` and ``b`` within the distance that connect all that such links connect."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    in_a, in_b = place[: len(a)], place[len(a) :]
    tree = np.arange(len(nodes))
    left, right = [], []
    for i in in_a:
        near = in_b[np.bitwise_count(nodes[i] ^ nodes[in_b]) <= distance]
        trees, first = np.unique(tree[near], return_index=True)
        new = trees != tree[i]
        if new.any():
            left.append(np.full(int(new.sum()), nodes[i]))
            right.append(nodes[near[first[new]]])
            tree[np.isin(tree, trees[new])] = tree[i]
    if not left:
        return nodes[:0], nodes[:0]
    return np.concatenate(left), np.concatenate(right)


def _links(pairs: DataFrame, distance: int) -> DataFrame:
    def start():
        def work(part):
            a, b = part.column("a"), part.column("b")
            size_a, size_b = a.value_lengths().to_numpy(), b.value_lengths().to_numpy()
            flat_a = a.flatten().to_numpy().view(np.uint64)
            flat_b = b.flatten().to_numpy().view(np.uint64)
            begin_a, begin_b = np.cumsum(size_a) - size_a, np.cumsum(size_b) - size_b
            single = (size_a == 1) & (size_b == 1)
            one_a, one_b = flat_a[begin_a[single]], flat_b[begin_b[single]]
            near = np.bitwise_count(one_a ^ one_b) <= distance
            left, right = [one_a[near]], [one_b[near]]
            for k in np.flatnonzero(~single):
                x, y = forest(
                    flat_a[begin_a[k] : begin_a[k] + size_a[k]], flat_b[begin_b[k] : begin_b[k] + size_b[k]], distance
                )
                left.append(x)
                right.append(y)
            return {"x": np.concatenate(left).view(np.int64), "y": np.concatenate(right).view(np.int64)}

        return work

    return map_slices(pairs, "x long, y long", start)


def near_links(fps: DataFrame, distance: int = DISTANCE, class_rows: int = CLASS_ROWS) -> DataFrame:
    """``x`` and ``y``: links within ``distance`` that connect all fingerprints ``fp`` which such links connect.

    ``fps`` has each fingerprint once. Complete for distances up to 3, as two segments are probed with radius 1.
    """
    if not 0 <= distance <= 3:
        raise ValueError("two segments with balls of radius 1 find distances up to 3")
    return _links(_class_pairs(materialize(_classes(fps, class_rows), "classes")), distance)


def near_duplicates(df: DataFrame, key: str, text: str, distance: int = DISTANCE, class_rows: int = CLASS_ROWS) -> DataFrame:
    """``key``, ``fp`` and ``component`` (the smallest key that links reach) for every row of ``df``.

    Null and blank texts have the fingerprint zero, which links like any other. Repeated rows stay repeated. A null
    key has a fingerprint and a component, but is never a component's name while another key is in it.
    """
    prints = materialize(fingerprints(df, key, text), "fingerprints")
    least = prints.groupBy("fp").agg(F.min(key).alias("least"))
    roots = connected_components(near_links(least.select("fp"), distance, class_rows), "x", "y")
    roots = roots.select(F.col("node").alias("fp"), "root")
    named = least.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    components = named.groupBy("root").agg(F.min("least").alias("component"))
    names = named.join(components, "root").select("fp", "component")
    return prints.join(names, "fp").select(key, "fp", "component")


def hex_fingerprint(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def one_of_each(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row of each component, all columns unchanged: the one with the component's smallest key.

    Rows with one key are one document, of which one row stays. Rows without a key can't be named: they all stay.
    """
    kept = near_duplicates(df.where(F.col(key).isNotNull()), key, text).where(F.col(key) == F.col("component"))
    names = kept.select(F.col(key).alias("__kept")).distinct()
    return (
        df.where(F.col(key).isNotNull())
        .join(names, F.col(key) == F.col("__kept"), "left_semi")
        .dropDuplicates([key])
        .unionByName(df.where(F.col(key).isNull()))
    )
