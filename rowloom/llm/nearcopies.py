"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Equal sets are reduced to one, a *node*. Candidates come from two searches. The multi-index search of :mod:`simhash` finds
fingerprints within 3 bits, which are the closest copies. At a similarity of 0.8 two fingerprints differ in 10 of 64 bits
on average, and no segments and balls of bearable size meet there, so the rest meet in buckets of MinHash bands (16 bands
of 4 values: a pair at 0.8 shares no bucket once in 4,600 times, a closer pair more rarely). What is proposed is
verified on the shingles themselves, and components follow from the verified links.

The members of a bucket are kept in *classes* of bounded size. A class proposes spanning trees of its likest pairs, so
the links grow with its members, not with their square. A crowded bucket has several classes: it is dealt by hash, and
once more by the members' next band, which brings the likest together; every member is in as many different deals as it
has bands. All pairs of a class are estimated, but never all of a crowded bucket.

What both searches miss is found by an exact join. Under any fixed order of the shingles, the first ones of two similar
sets (a fifth and one more) have a shingle in common, so rows meet by these *prefixes*. Only pairs of different
components meet, as the others are joined already; a pair with too few common shingles in its prefixes to reach the
similarity goes, the rest is verified. Shingles that many texts have come last in the order, so that they are in few prefixes.

Pairs meet one by one only at shingles of few prefixes, so their number grows with the prefixes. The texts with a shingle
of more prefixes are a *crowd*; shingles that much the same texts have are one crowd, named by the smallest hash of its
nodes, so that a group of texts meets once and not at every shingle. A crowd is dealt to blocks of bounded size, and every
two blocks are compared on their whole sets inside a task, which returns the links that connect components (a spanning
forest), never all pairs. A component that fills blocks of its own is not compared with itself.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rowloom.llm import simhash
from rowloom.llm.components import connected_components
from rowloom.llm.simhash import shingle_hashes
from rowloom.llm.slices import map_slices
from rowloom.operators.numbering import first_per_group
from rowloom.session import discard, scratch_path

SHINGLE_WORDS = 5
SIMILARITY = 0.8
BANDS, BAND_ROWS = 16, 4
# Members of a bucket that are compared as one block.
CLASS_ROWS = 1024
# Pairs below this estimated similarity are not proposed; an estimate is off by 0.05 or so.
LEAST_ESTIMATE = 0.65
# Shingle hashes whose least values are taken at a time.
HASHED = 2048
# One text in so many tells which shingles are common: those that come so often among them, of these the most frequent.
# They change the order of the prefixes, so the speed, never the pairs.
COMMON_SHARE, COMMON_LEAST, COMMON_ROWS = 16, 4, 1 << 18
# Prefixes with one shingle that meet pair by pair; more of them are a crowd.
CROWD_ROWS = 64
# A block of a crowd has about CLASS_ROWS members at most, and about so many shingles.
BLOCK_SHINGLES = 1 << 17

_random = np.random.default_rng(42)
_FACTORS = _random.integers(0, 1 << 63, BANDS * BAND_ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_MASKS = _random.integers(0, 1 << 63, BANDS * BAND_ROWS, np.uint64) * np.uint64(2)
# Parts of a sketch that give a spanning tree each: the whole of it and both halves, whose errors are independent.
_VIEWS = (slice(None), slice(0, BANDS * BAND_ROWS // 2), slice(BANDS * BAND_ROWS // 2, None))


def shingle_set(text: str | None) -> np.ndarray:
    """Hashes of the different shingles of the text, in order; a text of fewer words is one shingle, a blank one none."""
    return np.unique(shingle_hashes(text, SHINGLE_WORDS))


def least_values(shingles: np.ndarray) -> np.ndarray:
    """MinHash: the least value of the set under each of 64 hash functions."""
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max)
    for at in range(0, len(shingles), HASHED):
        values = (shingles[at : at + HASHED, None] ^ _MASKS) * _FACTORS
        least = np.minimum(least, values.min(axis=0))
    return least


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Share of common members of two ordered sets; two empty sets are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def _written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def _named(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, ``name`` (MD5 of the text) and ``text`` of every row; a null text is an empty one."""
    words = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return df.select(F.col(key).alias("key"), F.unhex(F.md5(words)).alias("name"), words.alias("text"))


def common_shingles(named: DataFrame) -> np.ndarray:
    """Hashes of shingles that many texts have, the most frequent last."""

    def start():
        def work(part):
            sets = [shingle_set(x) for x in part.column("text").to_pylist()]
            return {"shingle": np.concatenate(sets).view(np.int64)}

        return work

    some = named.where(F.pmod(F.xxhash64("key", "name"), F.lit(COMMON_SHARE)) == 0)
    counts = map_slices(some.select("text"), "shingle long", start, "text").groupBy("shingle").count()
    found = counts.where(F.col("count") >= COMMON_LEAST).orderBy(F.desc("count"), "shingle").limit(COMMON_ROWS)
    return found.select("shingle").toArrow().column(0).to_numpy()[::-1].astype(np.int64).view(np.uint64)


def prefix_size(size: int, similarity: float = SIMILARITY) -> int:
    """How many of its first shingles a set needs to share one with the first of any set that is as similar."""
    return size - int(np.ceil(similarity * size - 1e-6)) + 1 if size else 0


def in_order(shingles: np.ndarray, common: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The ordered set with its common shingles last, these by rank; ``common`` is ordered by hash."""
    if not len(common):
        return shingles
    at = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
    known = common[at] == shingles
    if not known.any():
        return shingles
    return np.concatenate([shingles[~known], shingles[known][np.argsort(ranks[at[known]])]])


def _sketches(named: DataFrame) -> DataFrame:
    """``key``, ``name``, ``digest`` of the shingle set, its fingerprint ``fp``, ``bands``, a byte of each least value,
    the ``size`` of the set and 32 bits of each shingle of its ``prefix``.
    """
    frequent = common_shingles(named)
    ranks = np.argsort(frequent).astype(np.int32)
    common = frequent[ranks]
    more = StructType.fromDDL("digest binary, fp long, bands array<long>, sketch binary, size int, prefix array<int>")
    kind = StructType([*named.select("key", "name").schema.fields, *more.fields])

    def start():
        def work(part):
            digests, fps, bands, sketches, sizes, prefixes = [], [], [], [], [], []
            for value in part.column(2).to_pylist():
                shingles = shingle_set(value)
                least = least_values(shingles)
                digests.append(xxhash.xxh3_128_digest(shingles.tobytes()))
                fps.append(simhash.fingerprint(shingles))
                found = [xxhash.xxh64_intdigest(x.tobytes(), k) for k, x in enumerate(least.reshape(BANDS, BAND_ROWS))]
                bands.append(np.array(found, np.uint64).view(np.int64))
                sketches.append((least & np.uint64(255)).astype(np.uint8).tobytes())
                sizes.append(len(shingles))
                first = in_order(shingles, common, ranks)[: prefix_size(len(shingles))]
                prefixes.append(first.astype(np.uint32).view(np.int32))
            named = {"key": part.column(0), "name": part.column(1), "size": sizes, "prefix": prefixes}
            return {**named, "digest": digests, "fp": fps, "bands": bands, "sketch": sketches}

        return work

    return map_slices(named, kind, start, "text")


def _classes(nodes: DataFrame, class_rows: int) -> DataFrame:
    """``members`` of every class: arrays of at most about ``class_rows`` nodes, two at least."""

    def crowded(rows: DataFrame) -> DataFrame:
        counts = rows.groupBy("bucket").count().where(F.col("count") > class_rows)
        return counts.select("bucket", F.ceil(F.col("count") / class_rows).alias("parts"))

    def dealt(rows: DataFrame) -> DataFrame:
        """Rows by bucket, ``parts`` null where it is not crowded."""
        return rows.join(crowded(rows), "bucket", "left")

    def gathered(rows: DataFrame) -> DataFrame:
        part = F.pmod(F.xxhash64("node", "bucket"), F.coalesce("parts", F.lit(1)))
        return rows.groupBy("bucket", part.alias("part")).agg(F.array_sort(F.collect_list("node")).alias("members"))

    bands = nodes.select("node", "bands", F.posexplode("bands").alias("at", "bucket"))
    following = F.element_at("bands", F.pmod(F.col("at") + 1, F.lit(BANDS)) + 1)
    rows = dealt(bands.select("node", "bucket", F.xxhash64("bucket", following).alias("finer")))
    finer = dealt(rows.where("parts IS NOT NULL").select("node", F.col("finer").alias("bucket")))
    classes = gathered(rows).unionByName(gathered(finer))
    return classes.where(F.size("members") > 1).select("members")


def spanning_trees(sketches: np.ndarray) -> np.ndarray:
    """Links (rows of two places) of a likest spanning forest for each view of the sketches, each link once.

    A forest of the likest pairs connects, at every level of similarity, all that pairs of that level connect.
    """
    links = set()
    for view in _VIEWS:
        values = np.ascontiguousarray(sketches[:, view])
        rest = np.arange(1, len(values))
        best, partner = (values[rest] == values[0]).mean(axis=1), np.zeros(len(rest), np.int64)
        while len(rest):
            at = int(best.argmax())
            node, near, other = rest[at], best[at], partner[at]
            if near >= LEAST_ESTIMATE:
                links.add((min(node, other), max(node, other)))
            keep = np.arange(len(rest)) != at
            rest, best, partner = rest[keep], best[keep], partner[keep]
            likeness = (values[rest] == values[node]).mean(axis=1)
            closer = likeness > best
            best[closer], partner[closer] = likeness[closer], node
    return np.array(sorted(links), np.int64).reshape(-1, 2)


def _tree_links(classes: DataFrame, nodes: DataFrame) -> DataFrame:
    """``x`` and ``y``: links that the classes propose."""
    members = classes.withColumn("class", F.monotonically_increasing_id())
    held = (
        members.select("class", F.explode("members").alias("node"))
        .join(nodes.select("node", "sketch"), "node")
        .groupBy("class")
        .agg(F.collect_list(F.struct("node", "sketch")).alias("members"))
    )

    def start():
        def work(part):
            left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for members in part.column("members"):
                values = members.values
                names = values.field("node").to_numpy()
                order = np.argsort(names)
                sketches = np.frombuffer(b"".join(values.field("sketch").to_pylist()), np.uint8).reshape(len(names), -1)
                links = spanning_trees(sketches[order])
                left.append(names[order][links[:, 0]])
                right.append(names[order][links[:, 1]])
            return {"x": np.concatenate(left), "y": np.concatenate(right)}

        return work

    return map_slices(held.select("members"), "x long, y long", start)


def candidates(nodes: DataFrame, class_rows: int = CLASS_ROWS) -> tuple[DataFrame, list[str]]:
    """``x`` < ``y``: pairs of nodes that either search proposes, each once; and the folders read for them."""
    classes, path = _written(_classes(nodes, class_rows), "classes")
    pairs = classes.where(F.size("members") == 2).select(F.col("members")[0].alias("x"), F.col("members")[1].alias("y"))
    trees = _tree_links(classes.where(F.size("members") > 2), nodes)

    named = nodes.groupBy("fp").agg(F.min("node").alias("least"))
    equal = nodes.join(named, "fp").select(F.col("least").alias("x"), F.col("node").alias("y"))
    close = simhash.near_links(named.select("fp"))
    close = close.join(named.select(F.col("fp").alias("x"), F.col("least").alias("a")), "x")
    close = close.join(named.select(F.col("fp").alias("y"), F.col("least").alias("b")), "y")
    found = pairs.unionByName(trees).unionByName(equal).unionByName(close.select(F.col("a").alias("x"), F.col("b").alias("y")))
    return found.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).where("x <> y").distinct(), [path]


def _postings(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """``shingle``, ``node``, ``size`` and ``root``: the shingles of prefixes that nodes of different components share.

    ``rows`` is how many prefixes have the shingle, ``crowd`` the smallest hash of their nodes.
    """
    placed = nodes.join(roots, "node", "left").select("node", "size", "prefix", F.coalesce("root", "node").alias("root"))
    rows = placed.select(F.explode("prefix").alias("shingle"), "node", "size", "root")
    shared = rows.groupBy("shingle").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min(F.xxhash64("node")).alias("crowd"),
        F.min("root").alias("low"),
        F.max("root").alias("high"),
    )
    return rows.join(shared.where("low < high").select("shingle", "rows", "crowd"), "shingle")


def missed(postings: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``x`` and ``y``: pairs of nodes of different components that may be as similar, each once; without what only crowds show.

    Common shingles of two sets are in both prefixes, or beyond the prefix that ends first. Shingles that share their
    32 bits are counted as common, so they propose more pairs, never fewer. A pair that has a shingle of a crowd too is
    compared there, so it may go here.
    """
    few = postings.where(F.col("rows") <= CROWD_ROWS)

    def side(name: str) -> DataFrame:
        return few.select(*[F.col(c).alias(f"{name}_{c}") for c in ("shingle", "size", "root")], F.col("node").alias(name))

    small, large = F.least("x_size", "y_size"), F.greatest("x_size", "y_size")
    met = (F.col("x_shingle") == F.col("y_shingle")) & (F.col("x_root") < F.col("y_root"))
    pairs = side("x").join(side("y"), met & (small >= similarity * large - 1e-6))
    counted = pairs.groupBy("x", "y", "x_size", "y_size").agg(F.count(F.lit(1)).alias("both"))
    most = F.col("both") + F.ceil(similarity * large - 1e-6) - 1
    return counted.where(most * (1 + similarity) >= similarity * (small + large) - 1e-6).select("x", "y")


def _shingle_sets(texts: DataFrame) -> DataFrame:
    """``node`` and its ordered ``shingles``, 8 bytes each, of every text."""

    def start():
        return lambda part: {
            "node": part.column(0),
            "shingles": [shingle_set(x).tobytes() for x in part.column(1).to_pylist()],
        }

    return map_slices(texts.select("node", "text"), "node long, shingles binary", start, "text")


def _meetings(members: DataFrame) -> DataFrame:
    """``crowd``, blocks ``a`` <= ``b`` that meet, ``node``, ``root``, and whether the node is ``in_a``: a row per member.

    A component with more members of a crowd than a block holds has blocks of its own, which never meet each other.
    """
    rows, shingles = F.count(F.lit(1)) / F.lit(CLASS_ROWS), F.sum("size") / F.lit(BLOCK_SHINGLES)
    parts = F.ceil(F.greatest(rows, shingles)).alias("parts")
    own = members.groupBy("crowd", "root").agg(parts).where("parts > 1").select("crowd", "root", F.col("root").alias("owner"))
    owned = members.join(own, ["crowd", "root"], "left").withColumn("owner", F.coalesce("owner", F.lit(-1)))
    dealt = owned.groupBy("crowd", "owner").agg(parts)
    blocks = dealt.select("crowd", "owner", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    blocks = blocks.select("crowd", F.struct("owner", "part").alias("block"))
    placed = owned.join(dealt, ["crowd", "owner"]).withColumn("part", F.pmod(F.xxhash64("node", "crowd"), F.col("parts")))
    placed = placed.select("crowd", F.struct("owner", "part").alias("block"), "node", "root")
    a, b = (blocks.select("crowd", F.col("block").alias(name)) for name in "ab")
    apart = (F.col("a.owner") != F.col("b.owner")) | (F.col("a.owner") == -1)
    pairs = a.join(b, "crowd").where((F.col("a") <= F.col("b")) & apart)
    ends = F.when(F.col("a") == F.col("b"), F.array("a")).otherwise(F.array("a", "b"))
    met = pairs.select("crowd", "a", "b", F.explode(ends).alias("block")).join(placed, ["crowd", "block"])
    return met.select("crowd", "a", "b", "node", "root", (F.col("block") == F.col("a")).alias("in_a"))


def near_forest(
    sets: list[np.ndarray], roots: np.ndarray, left: np.ndarray, right: np.ndarray, similarity: float = SIMILARITY
) -> list[tuple[int, int]]:
    """Places of similar sets, one of ``left`` and one of ``right``, that connect all components such pairs connect."""
    trees = np.unique(roots, return_inverse=True)[1]
    links: list[tuple[int, int]] = []
    if not len(left) or not len(right) or trees.max() == 0:
        return links
    sizes = np.array([len(sets[j]) for j in right])
    flat, owner = np.concatenate([sets[j] for j in right]), np.repeat(np.arange(len(right)), sizes)
    order = np.argsort(flat)
    flat, owner = flat[order], owner[order]
    for i in left:
        begin = np.searchsorted(flat, sets[i], "left")
        count = np.searchsorted(flat, sets[i], "right") - begin
        begin, count = begin[count > 0], count[count > 0]
        at = np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(count.sum())
        both = np.bincount(owner[at], minlength=len(right))
        near = right[both / (len(sets[i]) + sizes - both) >= similarity]
        other, first = np.unique(trees[near], return_index=True)
        new = other != trees[i]
        if new.any():
            links += [(int(i), int(j)) for j in near[first[new]]]
            trees[np.isin(trees, other[new])] = trees[i]
    return links


def _crowd_links(meetings: DataFrame, sets: DataFrame) -> DataFrame:
    """``x`` and ``y``: verified links of crowds; ``sets`` has ``node`` and ``shingles``."""
    member = F.struct("node", "root", "in_a", "shingles")
    held = meetings.join(sets, "node").groupBy("crowd", "a", "b").agg(F.collect_list(member).alias("members"))

    def start():
        def work(part):
            x, y = [], []
            for members, alone in zip(part.column("members"), part.column("alone").to_pylist(), strict=True):
                values = members.values
                found = [np.frombuffer(v, np.uint64) for v in values.field("shingles").to_pylist()]
                in_a = np.array(values.field("in_a").to_pylist(), bool)
                left, right = np.flatnonzero(in_a), np.flatnonzero(in_a if alone else ~in_a)
                nodes = values.field("node").to_numpy()
                for i, j in near_forest(found, values.field("root").to_numpy(), left, right):
                    x.append(nodes[i])
                    y.append(nodes[j])
            return {"x": x, "y": y}

        return work

    alone = (F.col("a") == F.col("b")).alias("alone")
    return map_slices(held.select("members", alone), "x long, y long", start)


def verified(links: DataFrame, texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The links ``x`` and ``y`` whose texts' shingle sets are as similar at least; ``texts`` has ``node`` and ``text``."""
    met = links.join(texts.select(F.col("node").alias("x"), F.col("text").alias("x_text")), "x")
    met = met.join(texts.select(F.col("node").alias("y"), F.col("text").alias("y_text")), "y")

    def start():
        known = lru_cache(maxsize=64)(shingle_set)

        def work(part):
            pairs = zip(part.column("x_text").to_pylist(), part.column("y_text").to_pylist(), strict=True)
            near = np.array([jaccard(known(a), known(b)) >= similarity for a, b in pairs], bool)
            x, y = part.column("x").to_numpy(), part.column("y").to_numpy()
            return {"x": x[near], "y": y[near]}

        return work

    return map_slices(met.select("x", "y", "x_text", "y_text"), "x long, y long", start, "x_text")


def near_copies(df: DataFrame, key: str, text: str, class_rows: int = CLASS_ROWS) -> tuple[DataFrame, list[str]]:
    """``key``, ``name`` (MD5 of the text) and ``component`` of every row, and the folders that hold them.

    A component is a struct of the key and the name of its first row: smallest key, null keys last, then smallest name.
    Rows are told apart by key and text: different texts under one key are different documents. A blank or null text is
    a text without shingles; these are copies of each other.
    """
    spark = df.sparkSession
    named = _named(df, key, text)
    sketches, sketched_path = _written(_sketches(named), "sketches")
    order = F.struct(F.col("key").isNull().alias("missing"), "key", "name")
    kept = F.first(F.struct("fp", "bands", "sketch", "size", "prefix")).alias("s")
    sets = sketches.groupBy("digest").agg(F.min(order).alias("first"), kept)
    nodes, nodes_path = _written(sets.select(F.monotonically_increasing_id().alias("node"), "digest", "first", "s.*"), "nodes")

    def texts_of(ends: DataFrame) -> DataFrame:
        """``node`` and ``text`` of the nodes of ``ends``."""
        ends = ends.select("node").distinct().join(nodes, "node")
        ends = ends.select("node", F.col("first.key").alias("k"), F.col("first.name").alias("n"))
        met = named.join(ends, F.col("key").eqNullSafe(F.col("k")) & (F.col("name") == F.col("n")))
        # repeated rows have one text
        return met.groupBy("node").agg(F.min("text").alias("text"))

    def linked(proposed: DataFrame) -> tuple[DataFrame, list[str]]:
        """The proposed links that hold, and the folders read for them."""
        links, links_path = _written(proposed, "candidates")
        texts, texts_path = _written(texts_of(links.select(F.explode(F.array("x", "y")).alias("node"))), "linked-texts")
        return verified(links, texts), [links_path, texts_path]

    proposed, classes = candidates(nodes, class_rows)
    links, read = linked(proposed)
    roots, roots_path = _written(connected_components(links, "x", "y"), "roots")
    discard(spark, *classes, *read)
    postings, postings_path = _written(_postings(nodes, roots), "postings")
    links, read = linked(missed(postings))
    members, members_path = _written(
        postings.where(F.col("rows") > CROWD_ROWS).select("crowd", "node", "size", "root").distinct(), "crowds"
    )
    wholes, wholes_path = _written(_shingle_sets(texts_of(members)), "crowd-sets")
    links = links.unionByName(_crowd_links(_meetings(members), wholes))
    read += [postings_path, members_path, wholes_path]
    ends = nodes.select("node").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    for end in "xy":
        links = links.join(ends.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root")), end)
    joined = connected_components(links, "x_root", "y_root").select(F.col("node").alias("root"), F.col("root").alias("last"))
    placed = nodes.select("node", "digest", "first").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    placed = placed.join(joined, "root", "left").select("digest", "first", F.coalesce("last", "root").alias("root"))
    firsts = placed.groupBy("root").agg(F.min("first").alias("component"))
    named_sets = placed.join(firsts, "root").select("digest", F.struct("component.key", "component.name").alias("component"))
    found, path = _written(sketches.join(named_sets, "digest").select("key", "name", "component"), "near-copies")
    discard(spark, sketched_path, nodes_path, roots_path, *read)
    return found, [path]


def one_of_each(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row of each component, all columns unchanged: the one with the smallest key, null keys last.

    Among different texts of one key the smallest MD5 counts. Of rows repeated with key and text one stays: the one whose
    other columns have the smallest hash. Only the names of the kept rows stay written once this returns.
    """
    found, paths = near_copies(df, key, text)
    own = F.struct("key", "name")
    rows = found.where(own.eqNullSafe(F.col("component"))).groupBy("key", "name").agg(F.count(F.lit(1)).alias("copies"))
    kept, _ = _written(rows, "kept")
    discard(df.sparkSession, *paths)
    kept = kept.select(F.col("key").alias("__key"), F.col("name").alias("__kept"), "copies")
    name = F.unhex(F.md5(F.coalesce(F.col(text).cast("string"), F.lit(""))))
    marked = df.withColumn("__name", name)
    same = F.col(key).eqNullSafe(F.col("__key")) & (F.col("__name") == F.col("__kept"))
    single = marked.join(kept.where("copies = 1"), same, "left_semi")
    repeated = marked.join(kept.where("copies > 1"), same, "left_semi")
    plain = [f.name for f in df.schema.fields if not any(t in f.dataType.simpleString() for t in ("map<", "variant"))]
    one = first_per_group(repeated, [F.col(key), F.col("__name")], [F.xxhash64(*plain)], 1, "__rank").drop("__rank")
    return single.unionByName(one).select(*df.columns)
