"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are the windows of consecutive words of the benchmark items, the alphabet is the words. A table gives,
for a block of words at the end of the search window, how far the window may move without missing a pattern; a block
no pattern holds moves it by nearly a whole pattern. Where the shift is zero the block selects the few patterns that
end with it, and a direct comparison of all their words confirms an occurrence.

Documents are read once, whole, and never shuffled. The patterns reach the tasks in blocks of bounded size; a
benchmark of several blocks takes as many steps in the same pass.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm.slices import map_slices

WINDOW = 13
BLOCK = 3
# Words of benchmark items that are broadcast together.
BLOCK_WORDS = 1_000_000
# A document is contaminated from this share of hit words on: one in so many.
ONE_IN = 20

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: str | None) -> list[bytes]:
    """Runs of digits, letters and signs beyond ASCII, A-Z lower-cased, as UTF-8."""
    return _WORD.findall((text or "").encode("utf-8", "replace").lower())


class PatternSet:
    """Shift and suffix tables for the windows of some items, by pattern length."""

    def __init__(self, items: Iterable[tuple[object, list[bytes]]], window: int = WINDOW):
        patterns: dict[int, dict[tuple[bytes, ...], list[object]]] = defaultdict(lambda: defaultdict(list))
        for item, words in items:
            for at in range(max(1, len(words) - window + 1) if words else 0):
                owners = patterns[min(window, len(words))][tuple(words[at : at + window])]
                if not owners or owners[-1] != item:
                    owners.append(item)
        self.tables = [self._tables(length, found) for length, found in sorted(patterns.items())]

    @staticmethod
    def _tables(length: int, patterns: dict[tuple[bytes, ...], list[object]]):
        block = min(BLOCK, length)
        shift: dict[tuple[bytes, ...], int] = {}
        ending: dict[tuple[bytes, ...], list[tuple[tuple[bytes, ...], list[object]]]] = defaultdict(list)
        for pattern, owners in patterns.items():
            for end in range(block, length + 1):
                key = pattern[end - block : end]
                shift[key] = min(shift.get(key, length), length - end)
            ending[pattern[length - block :]].append((pattern, owners))
        return length, block, length - block + 1, shift, dict(ending)

    def search(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[object]]:
        """Merged [start, end) spans of words inside occurrences, and the items whose windows occur."""
        spans, items = [], set()
        for length, block, furthest, shift, ending in self.tables:
            end, last, move = length, len(words), shift.get
            while end <= last:
                key = tuple(words[end - block : end])
                step = move(key, furthest)
                if step:
                    end += step
                    continue
                for pattern, owners in ending[key]:
                    if tuple(words[end - length : end]) == pattern:
                        spans.append((end - length, end))
                        items.update(owners)
                end += 1
        return merged(spans), items


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    found: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if found and start <= found[-1][1]:
            found[-1] = (found[-1][0], max(end, found[-1][1]))
        else:
            found.append((start, end))
    return found


def pattern_blocks(items: DataFrame, key: str, text: str, block_words: int, window: int) -> Iterator[PatternSet]:
    """The items in blocks of about ``block_words`` words, read through the driver block by block.

    The caller broadcasts them; they stay until the result that needs them has been read.
    """
    held, size = [], 0
    for item, found in items.where(F.col(text).isNotNull()).select(key, text).toLocalIterator():
        words = words_of(found)
        held.append((item, words))
        size += len(words)
        if size >= block_words:
            yield PatternSet(held, window)
            held, size = [], 0
    if held:
        yield PatternSet(held, window)


def overlaps(
    docs: DataFrame,
    text: str,
    items: DataFrame,
    item_key: str,
    item_text: str,
    keep: list[str],
    window: int = WINDOW,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """The columns ``keep``, then ``n_words``, ``spans`` (hit words, merged, [start, end)) and ``items`` (sorted texts).

    Every row of ``docs`` gives one row. Null texts, blank texts and texts without words have no words and no spans;
    items without words match nothing, items with fewer words than a window are one window. Items without a key
    count under the name ``null``.
    """
    spark = docs.sparkSession
    found = docs.select(*keep, F.col(text).alias("__text")).withColumns(
        {
            "n_words": F.lit(0).cast("long"),
            "spans": F.array().cast("array<struct<start:int,end:int>>"),
            "items": F.array().cast("array<string>"),
        }
    )
    names = found.columns
    at = len(keep)

    def step(shared):
        def start():
            patterns = shared.value

            def work(part):
                counts, spans, items = [], [], []
                before = zip(part.column(at + 2).to_pylist(), part.column(at + 3).to_pylist(), strict=True)
                for body, (old_spans, old_items) in zip(part.column(at).to_pylist(), before, strict=True):
                    words = words_of(body)
                    new_spans, new_items = patterns.search(words)
                    counts.append(len(words))
                    old = [(s["start"], s["end"]) for s in old_spans]
                    spans.append([{"start": a, "end": b} for a, b in merged(old + new_spans)])
                    items.append(sorted({*old_items, *("null" if x is None else str(x) for x in new_items)}))
                columns = [part.column(i) for i in range(at + 1)]
                return dict(zip(names, [*columns, counts, spans, items], strict=True))

            return work

        return start

    blocks = 0
    for block in pattern_blocks(items, item_key, item_text, block_words, window):
        found = map_slices(found, found.schema, step(spark.sparkContext.broadcast(block)), "__text")
        blocks += 1
    if not blocks:
        found = map_slices(found, found.schema, step(spark.sparkContext.broadcast(PatternSet([], window))), "__text")
    return found.drop("__text")


def n_hit(spans: str = "spans"):
    """Number of hit words, as a column."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])


def is_contaminated(spans: str = "spans", words: str = "n_words", one_in: int = ONE_IN):
    """Some words are hit, and at least one in ``one_in`` of all words."""
    hit = n_hit(spans)
    return (hit > 0) & (one_in * hit >= F.col(words))


def clean_rows(docs: DataFrame, text: str, items: DataFrame, item_key: str, item_text: str) -> DataFrame:
    """The rows that are not contaminated, all columns unchanged."""
    inner = [f"__c{i}" for i in range(len(docs.columns))]
    renamed = docs.toDF(*inner)
    found = overlaps(renamed, inner[docs.columns.index(text)], items, item_key, item_text, inner)
    return found.where(~is_contaminated()).select(*inner).toDF(*docs.columns)
