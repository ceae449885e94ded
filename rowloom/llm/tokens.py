"""Exact token ids and token counts of whole texts, through caches of words.

A byte-level BPE tokenizer splits a text before it merges, and never within a run of non-blank signs and the one
blank before it. So a text's ids are those of such runs, one after another, and a run's ids can be kept. The library
itself encodes every run that is not kept; texts for which the rule above is not proven go to it whole.
"""

from __future__ import annotations

import json
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm.slices import map_slices, slices

# Runs that a worker keeps, at most; a full cache starts again.
KEPT_RUNS = 400_000
# Frequent runs that are broadcast, and the rows they are counted in. Both change the speed only.
FREQUENT_RUNS = 65_536
FREQUENT_ROWS = 4_096

# A run with the blank before it, or blanks as the tokenizer groups them.
_RUN = re.compile(r" ?\S+|\s+(?!\S)|\s+")
# Blanks other than single blanks and line ends; signs on whose being blank libraries differ.
_BLANKS = [*"\t\r\x0b\x0c\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000", *map(chr, range(0x2000, 0x200B))]
_DOUBLE = ["  ", " \n", "\n ", "\n\n"]
_UNSURE = [*"\x1c\x1d\x1e\x1f\u180e\u200b\ufeff"]
# Letters, then punctuation: two parts for the tokenizer, each without another split.
_PLAIN = re.compile("( ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f]+)([.,!?;:%&*#$|()]*)")


def _unsure(text: str) -> bool:
    return any(map(text.__contains__, _UNSURE))


def _even(text: str) -> bool:
    """Words of the text are parted by single blanks or line ends, with none around them."""
    return not (
        text[0].isspace()
        or text[-1].isspace()
        or any(map(text.__contains__, _DOUBLE))
        or any(map(text.__contains__, _BLANKS))
    )


class RunCoder:
    """Ids of texts as bytes of little-endian unsigned integers, 16 bits wide where the vocabulary allows."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        described = json.loads(self.library.to_str())
        narrow = self.library.get_vocab_size(with_added_tokens=True) <= 1 << 16
        self.dtype, self.code = np.dtype("<u2" if narrow else "<u4"), "H" if narrow else "I"
        self.spaced: dict[str, bytes] = {}
        self.bare: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        added = described["added_tokens"]
        before = described.get("pre_tokenizer") or {}
        # Only this kind of tokenizer is known to split as described above.
        self.splits = (
            described.get("normalizer") is None
            and before.get("type") == "ByteLevel"
            and before.get("use_regex") is True
            and before.get("add_prefix_space") is False
            and described["model"]["type"] == "BPE"
            and not described["model"].get("dropout")
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added)
        )
        self.specials = {t["content"]: np.array([t["id"]], self.dtype).tobytes() for t in added}
        self.special = re.compile("|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) or r"(?!)")
        self.alphabet = self._alphabet()
        self.merges = self.library.model.tokenize

    @staticmethod
    def _alphabet() -> dict[int, str]:
        """The sign that stands for each byte: itself if it prints, else the next free one from 256 on."""
        table, free = {}, 256
        for b in range(256):
            if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174:
                table[b] = chr(b)
            else:
                table[b] = chr(free)
                free += 1
        return table

    def _by_library(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _part(self, part: str) -> bytes:
        """Ids of a text that the tokenizer doesn't split, by the library's merges alone."""
        found = self.parts.get(part)
        if found is None:
            signs = part.encode().decode("latin-1").translate(self.alphabet)
            found = self._merged(signs)
            if len(self.parts) >= KEPT_RUNS // 4:
                self.parts.clear()
            self.parts[part] = found
        return found

    def run(self, run: str) -> bytes:
        """Ids of one run, by the library."""
        plain = _PLAIN.fullmatch(run)
        if not plain:
            return self._by_library(run)
        letters, signs = plain.groups()
        return self._part(letters) + (self._part(signs) if signs else b"")

    def _merged(self, signs: str) -> bytes:
        return array(self.code, [t.id for t in self.merges(signs)]).tobytes()

    def _fill(self, kept: dict[str, bytes], blank: str, word: str) -> bytes:
        """Encode a word and keep it; one that ends in punctuation shares the ids of its letters."""
        before = self.alphabet[32] if blank else ""
        if word.isascii() and word.isalpha():
            found = self._merged(before + word)
        elif plain := _PLAIN.fullmatch(word):
            letters, signs = plain.groups()
            if signs and letters[0] != " ":
                found = (kept.get(letters) or self._fill(kept, blank, letters)) + self._part(signs)
            elif letters[0] != " ":
                found = self._merged(before + word.encode().decode("latin-1").translate(self.alphabet))
            else:
                found = self.run(blank + word)
        else:
            found = self.run(blank + word)
        if len(word) <= 32:
            if len(kept) >= KEPT_RUNS:
                kept.clear()
            kept[word] = found
        return found

    def _runs(self, text: str, out: list) -> None:
        """Append the ids of every run of a text without special strings."""
        if _unsure(text):
            out.append(self._by_library(text))
            return
        spaced, bare = self.spaced, self.bare
        if not _even(text):
            for run in _RUN.findall(text):
                if run[0] == " " and len(run) > 1 and not run.isspace():
                    out.append(spaced.get(run[1:]) or self._fill(spaced, " ", run[1:]))
                else:
                    out.append(bare.get(run) or self._fill(bare, "", run))
            return
        line_end = bare.get("\n") or self._fill(bare, "", "\n")
        for k, line in enumerate(text.split("\n")):
            if k:
                out.append(line_end)
            first, *words = line.split(" ")
            out.append(bare.get(first) or self._fill(bare, "", first))
            found = list(map(spaced.get, words))
            for at in [i for i, ids in enumerate(found) if ids is None]:
                found[at] = spaced.get(words[at]) or self._fill(spaced, " ", words[at])
            out += found

    def encode(self, text: str | None) -> bytes:
        """Ids of the whole text as the library gives them without added ones; special strings as its default."""
        if not text:
            return b""
        if not self.splits:
            return self._by_library(text)
        out: list[bytes] = []
        at = 0
        for hit in self.special.finditer(text) if any(map(text.__contains__, self.specials)) else ():
            if hit.start() > at:
                self._runs(text[at : hit.start()], out)
            out.append(self.specials[hit.group()])
            at = hit.end()
        if at < len(text):
            self._runs(text[at:] if at else text, out)
        return b"".join(out)


class RunCounter(RunCoder):
    """Numbers of tokens: a table of frequent runs first, then the worker's caches, then the library."""

    def __init__(self, path: str):
        super().__init__(path)
        self.spaced, self.bare = {}, {}
        self.frequent: dict[str, int] = {}

    def prime(self, frequent: dict[str, int]) -> None:
        self.frequent = frequent

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        width = self.dtype.itemsize
        if not self.splits or _unsure(text) or not _even(text) or any(map(text.__contains__, self.specials)):
            return len(self.encode(text)) // width
        total, frequent, lines = 0, self.frequent.get, text.count("\n")
        total += lines * (len(self.bare.get("\n") or self._fill(self.bare, "", "\n")) // width)
        for line in text.split("\n"):
            first, *words = line.split(" ")
            total += len(self.bare.get(first) or self._fill(self.bare, "", first)) // width
            known = list(map(frequent, words))
            if None in known:
                missed = [w for w, n in zip(words, known, strict=True) if n is None]
                total += sum(filter(None, known))
                for w in missed:
                    total += len(self.spaced.get(w) or self._fill(self.spaced, " ", w)) // width
            else:
                total += sum(known)
        return total


@cache
def coder(path: str) -> RunCoder:
    """The worker's coder of a vocabulary file; it outlives the task."""
    return RunCoder(path)


@cache
def counter(path: str) -> RunCounter:
    return RunCounter(path)


def frequent_lengths(df: DataFrame, text: str, path: str, rows: int = FREQUENT_ROWS, runs: int = FREQUENT_RUNS) -> dict[str, int]:
    """Token numbers of the commonest words after a blank, counted in about ``rows`` rows.

    The table steers speed alone: a word outside it is encoded. Words are counted in the tasks that read the drawn rows,
    and the counters are added up on the driver without any shuffle; there are no more of them than drawn rows. Rows are
    drawn one by one, so copies of a text are drawn like others.
    """
    total = df.count()
    drawn = df.select(F.col(text).alias("__text")).where(F.rand(5) < min(1.0, rows / max(1, total)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for part in slices(batch, "__text"):
                for body in part.column(0).to_pylist():
                    for line in (body or "").split("\n"):
                        seen.update(w for w in line.split(" ")[1:] if 0 < len(w) <= 32 and not any(map(w.__contains__, _BLANKS + _UNSURE)))
        common = seen.most_common(runs)
        if common:
            words, counts = zip(*common, strict=True)
            yield pa.record_batch([pa.array(words, pa.string()), pa.array(counts, pa.int64())], ["word", "n"])

    seen: Counter[str] = Counter()
    for r in drawn.mapInArrow(run, "word string, n long").toLocalIterator():
        seen[r["word"]] += r["n"]
    found = sorted(seen, key=lambda w: (-seen[w], w))[:runs]
    own = RunCoder(path)
    if not own.splits:
        return {}
    return {w: len(own.run(" " + w)) // own.dtype.itemsize for w in found}


def count_tokens(df: DataFrame, text: str, path: str, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and ``n_tokens`` for every row, without any shuffle of texts or of their words.

    Null and empty texts have no tokens.
    """
    table = df.sparkSession.sparkContext.broadcast(frequent_lengths(df, text, path))
    kind = df.select(*keep).schema.add("n_tokens", "long")

    def start():
        own = counter(path)
        own.prime(table.value)

        def work(part):
            counts = [own.count(x) for x in part.column(len(keep)).to_pylist()]
            return {**{c: part.column(i) for i, c in enumerate(keep)}, "n_tokens": counts}

        return work

    return map_slices(df.select(*keep, F.col(text).alias("__text")), kind, start, "__text")
