"""Spelling variants: words one edit apart, found by range searches in k-d trees over letter counts.

An inserted or deleted letter changes one letter count by one, a replaced letter two. So words one edit apart are of one
length and within an L1 distance of 2 by their letter counts, or of neighbouring lengths and within 1. For each length a
k-d tree cuts the space of letter counts into boxes. A word searches the boxes of its own length and of the next one
that are within that distance, and what it finds there is verified letter by letter.

The upper levels of the trees are fitted on a bounded sample of words (``SAMPLE_WORDS``), which decides only how evenly
words are dealt: every word is put into the box that it falls into, and a box of any number of words is kept in blocks of
bounded size. The levels below are built inside the tasks, over the words of a block.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm.slices import map_slices, slices
from rowloom.session import discard, materialize, scratch_path

RUN = re.compile("[a-zÀ-ÿ]+")
LEAST_LETTERS, LEAST_COUNT = 5, 3
# One run in so many loses a letter.
DAMAGED = 97
# A form occurs so many times as often as its variants, at least.
DOMINANCE = 2

# Letters of the alphabet that runs are made of: a-z and U+00C0 to U+00FF.
FIRST_ASCII, FIRST_LATIN, LETTERS = ord("a"), 0xC0, 26 + 64

# Different words that a task counts before it hands them on.
COUNTED_WORDS = 200_000
# Words that the upper levels of the trees are fitted on.
SAMPLE_WORDS = 200_000
# Words of a block, and letters of its words together; queries that a block answers at a time.
BLOCK_WORDS, BLOCK_LETTERS, QUERY_WORDS = 4096, 1 << 21, 8192
# Words of a leaf of the trees inside the tasks; pairs of query and leaf word verified at a time.
LEAF_WORDS, PAIRS = 16, 1 << 18


def words_of(key: object, text: str | None) -> Iterator[str]:
    """The words of a text: runs of letters, A-Z lower-cased; one in 97 by the crc32 of ``key:run`` has lost a letter.

    A missing key counts as an empty one. Words of fewer than 5 letters are left out.
    """
    seed = zlib.crc32(f"{'' if key is None else key}:".encode())
    for run in RUN.findall((text or "").encode("utf-8", "replace").lower().decode()):
        if len(run) < LEAST_LETTERS:
            continue
        digest = zlib.crc32(run.encode(), seed)
        if digest % DAMAGED == 0:
            at = digest % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < LEAST_LETTERS:
                continue
        yield run


def count_words(df: DataFrame, key: str, text: str, least: int = LEAST_COUNT) -> DataFrame:
    """``word`` and its occurrences ``n`` over all texts, where these are ``least`` or more; null texts have no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def packed():
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for part in slices(batch, "text"):
                for name, value in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    held.update(words_of(name, value))
                    if len(held) > COUNTED_WORDS:
                        yield packed()
                        held.clear()
        if held:
            yield packed()

    rows = df.select(F.col(key).cast("string").alias("key"), F.col(text).cast("string").alias("text"))
    counted = rows.mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def letters(words: list[str]) -> np.ndarray:
    """Words of one length as rows of code points."""
    return np.frombuffer("".join(words).encode("utf-16-le"), "<u2").reshape(len(words), -1)


def letter_counts(points: np.ndarray) -> np.ndarray:
    """How often each letter is in each word, in the narrowest type that holds the words' length."""
    place = np.where(points >= FIRST_LATIN, points - FIRST_LATIN + 26, points - FIRST_ASCII).astype(np.int64)
    rows = np.arange(len(points))[:, None] * LETTERS
    kind = np.int8 if points.shape[1] < 128 else np.int32
    return np.bincount((place + rows).ravel(), minlength=len(points) * LETTERS).reshape(-1, LETTERS).astype(kind)


@dataclass
class Node:
    """Bounds of a box; where it is split, the letter, the last count of the lower half, and the halves."""

    low: np.ndarray | None
    high: np.ndarray | None
    members: np.ndarray | None = None
    letter: int = -1
    split: int = 0
    lower: Node | None = None
    upper: Node | None = None
    number: int = -1


def build(counts: np.ndarray, members: np.ndarray, size: float) -> Node:
    """A k-d tree over rows of letter counts, split at the letter whose counts differ most, down to ``size`` members.

    Bounds are those of the members; a box of equal rows is not split, however many they are.
    """
    own = counts[members]
    node = Node(own.min(axis=0), own.max(axis=0))
    if len(members) > size and (node.low < node.high).any():
        spread = own.astype(np.float32).var(axis=0)
        node.letter = int(spread.argmax())
        values = own[:, node.letter]
        node.split = min(int(np.sort(values)[(len(values) - 1) // 2]), int(values.max()) - 1)
        node.lower = build(counts, members[values <= node.split], size)
        node.upper = build(counts, members[values > node.split], size)
    else:
        node.members = members
    return node


def distances(queries: np.ndarray, node: Node) -> np.ndarray:
    """L1 distance of each row of letter counts from a box."""
    wide = np.int16 if queries.dtype == np.int8 else np.int64
    return (np.maximum(queries - node.high, 0) + np.maximum(node.low - queries, 0)).sum(axis=1, dtype=wide)


def search(node: Node, queries: np.ndarray, asked: np.ndarray, radius: int) -> Iterator[tuple[Node, np.ndarray]]:
    """Leaves within the radius of any asked row of letter counts, each with the rows that it is near to."""
    near = asked[distances(queries[asked], node) <= radius]
    if not len(near):
        return
    if node.members is not None:
        yield node, near
        return
    yield from search(node.lower, queries, near, radius)
    yield from search(node.upper, queries, near, radius)


def one_replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether words of one length differ at one place exactly, row by row."""
    return (a != b).sum(axis=1) == 1


def one_inserted(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Whether the longer word is the shorter one with one more letter, row by row."""
    size = short.shape[1]
    begin = np.cumprod(short == long[:, :size], axis=1, dtype=np.int8).sum(axis=1, dtype=np.int64)
    end = np.cumprod((short == long[:, 1:])[:, ::-1], axis=1, dtype=np.int8).sum(axis=1, dtype=np.int64)
    return begin + end >= size


def near_pairs(queries: list[str], members: list[str], size: int = LEAF_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Places of queries and members that are one edit apart; each list is of one length, the members' is one more at most."""
    asked, known = letters(queries), letters(members)
    replaced = asked.shape[1] == known.shape[1]
    asked_counts, known_counts = letter_counts(asked), letter_counts(known)
    kind = np.promote_types(asked_counts.dtype, known_counts.dtype)
    asked_counts, known_counts = asked_counts.astype(kind), known_counts.astype(kind)
    tree = build(known_counts, np.arange(len(members)), size)
    radius = 2 if replaced else 1
    wide = np.int16 if kind == np.int8 else np.int64
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    step = max(1, PAIRS // asked.shape[1])
    for leaf, near in search(tree, asked_counts, np.arange(len(queries)), radius):
        rows = max(1, step // len(leaf.members))
        for at in range(0, len(near), rows):
            part = near[at : at + rows]
            x, y = np.repeat(part, len(leaf.members)), np.tile(leaf.members, len(part))
            close = np.abs(asked_counts[x] - known_counts[y]).sum(axis=1, dtype=wide) <= radius
            x, y = x[close], y[close]
            right_order = (one_replaced if replaced else one_inserted)(asked[x], known[y])
            left.append(x[right_order])
            right.append(y[right_order])
    return np.concatenate(left), np.concatenate(right)


class Boxes:
    """The upper levels of the trees of all lengths; their leaves, the boxes, are numbered."""

    def __init__(self, sample: list[str], share: float, words: int = BLOCK_WORDS):
        """``share`` is the sample's share of all words; boxes are split down to about ``words`` of these."""
        by_length: dict[int, list[str]] = {}
        for word in sample:
            by_length.setdefault(len(word), []).append(word)
        self.trees: dict[int, Node] = {}
        self.boxes = 0
        for length, own in sorted(by_length.items()):
            tree = build(letter_counts(letters(own)), np.arange(len(own)), max(1, _block_words(length, words) * share))
            self.trees[length] = tree
            self._number(tree)

    def _number(self, node: Node) -> None:
        node.low = node.high = None
        if node.members is not None:
            node.members, node.number = np.zeros(0, np.int64), self.boxes
            self.boxes += 1
            return
        self._number(node.lower)
        self._number(node.upper)

    def home(self, length: int, counts: np.ndarray) -> np.ndarray:
        """The box that each row of letter counts falls into; a length without a tree has one box below zero."""
        found = np.full(len(counts), -length, np.int64)
        if length in self.trees:
            self._fall(self.trees[length], counts, np.arange(len(counts)), found)
        return found

    def _fall(self, node: Node, counts: np.ndarray, rows: np.ndarray, found: np.ndarray) -> None:
        if node.members is not None:
            found[rows] = node.number
        elif len(rows):
            lower = counts[rows, node.letter] <= node.split
            self._fall(node.lower, counts, rows[lower], found)
            self._fall(node.upper, counts, rows[~lower], found)

    def reached(self, length: int, counts: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and boxes of a length within the radius of each other.

        A box holds all that falls into it, beyond the bounds of the sample too: what counts is how far a row is from
        the sides on which it was split off.
        """
        rows = np.arange(len(counts))
        if length not in self.trees:
            return rows, np.full(len(counts), -length, np.int64)
        left, right = [], []

        def go(node, rows, spent):
            if node.members is not None:
                left.append(rows)
                right.append(np.full(len(rows), node.number, np.int64))
                return
            over = counts[rows, node.letter].astype(np.int64) - node.split
            for half, beyond in ((node.lower, np.maximum(over, 0)), (node.upper, np.maximum(1 - over, 0))):
                # a letter that was crossed before counts once, with the greater of both distances
                crossed = {**spent, node.letter: np.maximum(spent.get(node.letter, 0), beyond)}
                near = sum(crossed.values()) <= radius
                if near.any():
                    go(half, rows[near], {k: (v[near] if isinstance(v, np.ndarray) else v) for k, v in crossed.items()})

        go(self.trees[length], rows, {})
        return np.concatenate(left), np.concatenate(right)


def _block_words(length: int, words: int = BLOCK_WORDS) -> int:
    return max(1, min(words, BLOCK_LETTERS // length))


def _written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


MEMBER, AT_HOME, ABROAD = range(3)


def fit_boxes(words: DataFrame, sample: int = SAMPLE_WORDS, block_words: int = BLOCK_WORDS) -> Boxes:
    """Trees over at most about ``sample`` words, taken by their hash."""
    total = words.count()
    share = min(1.0, sample / total) if total else 1.0
    taken = words if share == 1.0 else words.where(F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < int(share * (1 << 20)))
    return Boxes([r["word"] for r in taken.select("word").toLocalIterator()], share, block_words)


def _dealt(words: DataFrame, boxes: Boxes) -> DataFrame:
    """``box, role, word, n``: each word as a member of its home, and as a query of every box that it has to search.

    Of two words of one length, the one in the lower box searches the other's box.
    """

    def start():
        def work(part):
            texts = part.column(0).to_pylist()
            sizes = np.array([len(t) for t in texts])
            rows, found, role = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for length in np.unique(sizes):
                own = np.flatnonzero(sizes == length)
                # slices are of bounded bytes, and so are the letters of their words
                counts = letter_counts(letters([texts[i] for i in own]))
                home = boxes.home(int(length), counts)
                same, boxed = boxes.reached(int(length), counts, 2)
                later = boxed >= home[same]
                next_row, next_box = boxes.reached(int(length) + 1, counts, 1)
                rows += [own, own[same[later]], own[next_row]]
                found += [home, boxed[later], next_box]
                at_home = boxed[later] == home[same[later]]
                role += [np.full(len(own), MEMBER), np.where(at_home, AT_HOME, ABROAD), np.full(len(next_row), ABROAD)]
            at = pa.array(np.concatenate(rows))
            return {
                "box": np.concatenate(found),
                "role": np.concatenate(role),
                "word": part.column(0).take(at),
                "n": part.column(1).take(at),
            }

        return work

    return map_slices(words.select("word", "n"), "box long, role int, word string, n long", start, "word")


def _blocks(rows: DataFrame, most: int, name: str, *more: str) -> DataFrame:
    """``box, size`` and an array ``name`` of about ``most`` words at most, of bounded letters; dealt by hash."""
    rows = rows.withColumn("size", F.length("word"))
    fits = F.greatest(F.lit(1), F.least(F.lit(most), F.expr(f"{BLOCK_LETTERS} DIV size")))
    counts = rows.groupBy("box", "size").agg(F.count(F.lit(1)).alias("rows"))
    crowded = counts.select("box", "size", F.ceil(F.col("rows") / fits).alias("parts")).where("parts > 1")
    dealt = rows.join(crowded, ["box", "size"], "left")
    part = F.pmod(F.xxhash64("word"), F.coalesce("parts", F.lit(1)))
    return dealt.groupBy("box", "size", part.alias("part")).agg(F.collect_list(F.struct("word", "n", *more)).alias(name))


def near_words(words: DataFrame, boxes: Boxes, block_words: int = BLOCK_WORDS, query_words: int = QUERY_WORDS) -> DataFrame:
    """``word, n, other, other_n``: each pair of words one edit apart, in one of its directions."""
    dealt = materialize(_dealt(words, boxes), "dealt")
    held = _blocks(dealt.where(F.col("role") == MEMBER), block_words, "members")
    asked = _blocks(dealt.where(F.col("role") != MEMBER), query_words, "queries", "role")
    met = asked.join(held.select("box", "members"), "box").select("queries", "members")

    def start():
        def work(part):
            found = [[], [], [], []]
            for queries, members in zip(part.column("queries"), part.column("members"), strict=True):
                asked, known = queries.values, members.values
                x, y = near_pairs(asked.field("word").to_pylist(), known.field("word").to_pylist())
                word, other = asked.field("word").take(pa.array(x)), known.field("word").take(pa.array(y))
                # a pair of one box is found from both sides
                once = pc.or_(pc.equal(asked.field("role").take(pa.array(x)), ABROAD), pc.less(word, other))
                columns = (word, asked.field("n").take(pa.array(x)), other, known.field("n").take(pa.array(y)))
                for kept, column in zip(found, columns, strict=True):
                    kept.append(column.filter(once))
            return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in found], ["word", "n", "other", "other_n"])

        return work

    return map_slices(met, "word string, n long, other string, other_n long", start)


def roots(links: DataFrame) -> DataFrame:
    """``word`` and ``root``: where the links ``word`` to ``form`` lead in the end; they must not lead in circles.

    Each round doubles the links followed, so a chain of 1,000 takes ten. A round is written and the one before deleted.
    """
    spark = links.sparkSession
    current, path = _written(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = current.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = current.join(onward, "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")
        )
        after, after_path = _written(step, "roots")
        discard(spark, path)
        if after.where("moved").isEmpty():
            return after.select("word", "root")
        current, path = after.select("word", "root"), after_path


def variants(
    df: DataFrame, key: str, text: str, sample: int = SAMPLE_WORDS, block_words: int = BLOCK_WORDS, query_words: int = QUERY_WORDS
) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` of every word that occurs often enough in the texts.

    ``n_near`` counts the words one edit away. The ``form`` is the commonest of these (of equals the first in code-point
    order) if it is twice as common as the word, else null; ``root`` is where forms lead, the word itself without one.
    Null texts have no words; repeated rows count as often as they come; a table without words gives no rows.
    """
    words = materialize(count_words(df, key, text), "words")
    pairs = near_words(words, fit_boxes(words, sample, block_words), block_words, query_words)
    ways = F.array(
        F.struct(F.col("word"), F.col("n"), F.col("other"), F.col("other_n")),
        F.struct(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")),
    )
    near = (
        pairs.select(F.inline(ways))
        .groupBy("word", "n")
        .agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other"))).alias("best"))
    )
    form_n = -F.col("best.less")
    dominant = form_n >= DOMINANCE * F.col("n")
    formed = materialize(
        near.select("word", "n_near", F.when(dominant, F.col("best.other")).alias("form"), F.when(dominant, form_n).alias("form_n")),
        "forms",
    )
    ends = roots(formed.where(F.col("form").isNotNull()))
    return (
        words.join(formed, "word", "left")
        .join(ends, "word", "left")
        .select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            "form",
            "form_n",
            F.coalesce("root", "word").alias("root"),
        )
    )
