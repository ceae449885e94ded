"""Mixing sources to target weights by subset-sum budget fitting.

Each source gets a budget of words. Whole copies of the source fill what they can (none, one or two); the rest is
fitted exactly: documents are counted by length, most of the budget is taken in proportion to those counts, and a
bounded-knapsack dynamic program over the lengths left finds the sum closest to what remains. Which documents of a
length are taken follows from a seeded hash.

Only counts by (source, length) meet in one task, never documents. Selecting ``k`` of ``n`` documents of one length
splits long groups into hash buckets: buckets before the last are taken whole, and only one bucket is ranked, so a
source or a length that owns most rows is spread over many tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowloom.session import materialize

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
MOST_COPIES = 2
SEED = 20240607
# Rows of a (source, length) group that are ranked in one window.
RANKED = 4096

_WORD = r"[^\x20\x09-\x0D]+"
# Documents of more words are settled in units of several words.
DP_WORDS = 1 << 15


def n_words(text: Column) -> Column:
    """Number of words between ASCII blanks; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def source_targets(
    sizes: DataFrame, source: str, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, most: float = MOST_COPIES
) -> DataFrame:
    """Add ``target`` to a table with one row per source and its ``source_size``.

    Sources in code-point order, null last, weigh ``weights``, repeated. Targets share ``budget`` times all sizes by
    weight; what a source would get above ``most`` times its size is shared again among the others by weight, until
    none is above. Each round is one aggregate over the table of sources, of which two sums reach the driver.
    """
    order = Window.orderBy(F.col(source).isNull(), F.col(source))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1)
    ranked = materialize(sizes.withColumn("weight", weight.cast("double")), "sources")
    total = budget * (ranked.agg(F.sum("source_size")).first()[0] or 0)
    ceiling = most * F.col("source_size")
    price, capped = 0.0, -1
    while True:
        over = F.col("weight") * F.lit(price) > ceiling
        row = ranked.agg(
            F.coalesce(F.sum(F.when(over, ceiling)), F.lit(0)).alias("held"),
            F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0)).alias("open"),
            F.count_if(over).alias("capped"),
        ).first()
        if row["capped"] == capped:
            break
        capped = row["capped"]
        if not row["open"]:
            break
        price = (total - float(row["held"])) / row["open"]
    return ranked.withColumn("target", F.least(ceiling.cast("double"), F.col("weight") * F.lit(price))).drop("weight")


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that their words come as close to the budget as can be found.

    Never more than there are. The proportional part leaves a stretch of several of the longest documents, and less
    than one document of each length besides; what is beyond the stretch goes in from the longest on, and the dynamic
    program settles the rest. Its tables have 16 entries for each word of the longest document, up to ``DP_WORDS`` words:
    with longer documents it runs in units of several words first, then in words over those of at most that length.
    """
    counts = counts.astype(np.int64)
    lengths = lengths.astype(np.int64)
    taken = np.zeros(len(lengths), np.int64)
    have = int((lengths * counts).sum())
    if budget <= 0 or not have:
        return taken
    if budget >= have:
        return counts.copy()
    # Shares are rounded down in integers; Python's have no largest value.
    reach = 8 * int(lengths.max()) + 256
    taken[:] = [int(c) * max(0, budget - reach) // have for c in counts]
    left = budget - int((lengths * taken).sum())
    for i in np.argsort(-lengths, kind="stable"):
        if left <= 2 * reach:
            break
        more = min(int(counts[i] - taken[i]), (left - 2 * reach) // int(lengths[i]) + 1) if lengths[i] else 0
        taken[i] += more
        left -= more * int(lengths[i])
    unit = -(-int(lengths.max()) // DP_WORDS)
    if unit > 1:
        # Very long documents are settled in coarser units, rounded up, so that the sum stays within the budget.
        coarse = knapsack(-(-lengths // unit), counts - taken, left // unit)
        taken += coarse
        left -= int((lengths * coarse).sum())
    short = lengths <= DP_WORDS
    taken[short] += knapsack(lengths[short], (counts - taken)[short], min(left, 2 * (8 * DP_WORDS + 256)))
    return taken


def knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """Bounded knapsack: numbers up to ``counts`` whose total length is the largest one within the budget."""
    chosen = np.zeros(len(lengths), np.int64)
    if budget <= 0:
        return chosen
    first = np.full(budget + 1, -1, np.int64)  # the piece that first made a sum possible
    possible = np.zeros(budget + 1, bool)
    possible[0] = True
    pieces: list[tuple[int, int]] = []
    for i in np.argsort(-lengths, kind="stable"):
        length, rest, piece = int(lengths[i]), int(counts[i]), 1
        if not length:
            continue
        rest = min(rest, budget // length)
        while rest > 0:
            number = min(piece, rest)
            weight = number * length
            if weight <= budget:
                new = np.zeros(budget + 1, bool)
                new[weight:] = possible[: budget + 1 - weight]
                new &= ~possible
                first[new] = len(pieces)
                possible |= new
            pieces.append((int(i), number))
            rest -= number
            piece *= 2
        if possible[budget]:
            break
    at = int(np.flatnonzero(possible)[-1])
    while at:
        i, number = pieces[first[at]]
        chosen[i] += number
        at -= number * int(lengths[i])
    return chosen


def _plan(histogram: DataFrame) -> DataFrame:
    """Per source and length: ``n`` documents, ``copies`` of each, and ``extra`` documents with one copy more."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("size")
        size, target = int(frame["source_size"].iloc[0]), float(frame["target"].iloc[0])
        copies = min(MOST_COPIES, int(target // size)) if size else 0
        rest = 0 if copies >= MOST_COPIES else int(round(target - copies * size))
        frame["copies"] = copies
        frame["extra"] = fit(frame["size"].to_numpy(), frame["n"].to_numpy(), rest)
        return frame

    kind = "source string, size long, n long, source_size long, target double, copies int, extra long"
    return histogram.select("source", "size", "n", "source_size", "target").withColumns(
        {"copies": F.lit(0), "extra": F.lit(0).cast("long")}
    ).groupBy("source").applyInPandas(run, kind)


def mix(docs: DataFrame, key: str, size: str, source: str, seed: int = SEED) -> DataFrame:
    """``key``, ``source``, ``size``, then ``source_size``, ``target``, ``copies`` and ``extra`` for every row.

    The mix takes a row ``copies + extra`` times: 0, 1 or 2. ``docs`` needs these three columns only, no text.
    Documents without words may be taken, which adds nothing. A null source is a source of its own. Rows with one
    key, source and length are interchangeable: how many of them are taken is fixed, and so is the result.
    """
    rows = materialize(docs.select(F.col(key).alias("key"), F.col(source).alias("source"), F.col(size).alias("size")), "sizes")
    counted = materialize(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "lengths")
    targets = source_targets(
        counted.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), "source"
    )
    histogram = counted.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    plan = materialize(_plan(histogram), "mix-plan").withColumnsRenamed({"source": "p_source", "size": "p_size"})
    draw = F.xxhash64(F.lit(seed), F.col("key"))
    bucket = F.pmod(F.xxhash64(F.lit(seed + 1), F.col("key")), F.ceil(F.col("n") / RANKED))
    chosen = rows.join(plan, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("size") == F.col("p_size")))
    chosen = chosen.drop("p_source", "p_size").withColumns({"draw": draw, "bucket": bucket})

    # Where only some documents of a length get one copy more, they are ranked within their bucket, after all
    # documents of the buckets before. Only groups of several buckets need the counts of those.
    open_rows = chosen.where((F.col("extra") > 0) & (F.col("extra") < F.col("n")))
    earlier = Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        open_rows.where(F.col("n") > RANKED)
        .groupBy("source", "size", "bucket")
        .agg(F.count("*").alias("held"))
        .select(
            F.col("source").alias("b_source"),
            F.col("size").alias("b_size"),
            F.col("bucket").alias("b_bucket"),
            F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("before"),
        )
    )
    in_bucket = (
        F.col("source").eqNullSafe(F.col("b_source"))
        & (F.col("size") == F.col("b_size"))
        & (F.col("bucket") == F.col("b_bucket"))
    )
    rank = F.row_number().over(Window.partitionBy("source", "size", "bucket").orderBy("draw", "key"))
    ranked = open_rows.withColumn("rank", rank).join(before, in_bucket, "left")
    columns = [F.col("key").alias(key), F.col("source").alias(source), F.col("size").alias(size)]
    columns += ["source_size", "target", "copies"]
    settled = chosen.where((F.col("extra") == 0) | (F.col("extra") == F.col("n")))
    return settled.select(*columns, (F.col("extra") > 0).cast("int").alias("extra")).unionByName(
        ranked.select(
            *columns, (F.col("rank") + F.coalesce("before", F.lit(0)) <= F.col("extra")).cast("int").alias("extra")
        )
    )


def mixed_rows(df: DataFrame, key: str, text: str, source: str, seed: int = SEED) -> DataFrame:
    """The rows that the mix takes, as often as it takes them, all columns unchanged.

    Texts are shuffled once, to meet their document's decision. Of rows with one key, source and length, those with
    the smallest text hashes are taken once more, so reruns agree.
    """
    # A document's name as one text that is never null: rows with one name are interchangeable.
    def name(k, s, z):
        return F.concat_ws(
            "|",
            F.coalesce(F.concat(F.lit("="), k.cast("string")), F.lit("-")),
            z.cast("string"),
            F.coalesce(F.concat(F.lit("="), s.cast("string")), F.lit("-")),
        )

    size = n_words(F.col(text))
    light = df.select(F.col(key).alias("key"), F.col(source).alias("source"), size.alias("size"))
    decided = (
        mix(light, "key", "size", "source", seed)
        .groupBy(name(F.col("key"), F.col("source"), F.col("size")).alias("__of"))
        .agg(F.min("copies").alias("__copies"), F.sum("extra").alias("__extra"))
        .where((F.col("__copies") > 0) | (F.col("__extra") > 0))
    )
    inner = [f"__c{i}" for i in range(len(df.columns))]
    k, t, s = (F.col(inner[df.columns.index(c)]) for c in (key, text, source))
    rows = df.toDF(*inner).withColumn("__name", name(k, s, n_words(t)))
    met = rows.join(decided, F.col("__name") == F.col("__of"))
    place = F.row_number().over(Window.partitionBy("__name").orderBy(F.xxhash64(t)))
    times = F.col("__copies") + F.when(place <= F.col("__extra"), 1).otherwise(0)
    return (
        met.withColumn("__times", times)
        .select(*inner, F.explode(F.array_repeat(F.lit(0), F.col("__times"))).alias("__copy"))
        .select(*inner)
        .toDF(*df.columns)
    )
