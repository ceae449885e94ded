"""Spelling variants against brute force over all pairs of words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from rowloom.llm import spelling

KIND = "doc_id long, text string, word string, n int, form string, root string"


def counted(rows):
    held = Counter()
    for key, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            digest = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if digest % 97 == 0:
                at = digest % len(run)
                run = run[:at] + run[at + 1 :]
            held[run] += 1
    return {w: n for w, n in held.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    words = counted(rows)
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, n, len(near[w]), form[w], words.get(form[w]), root(w)) for w, n in words.items()}


def texts(seed, stems, rows):
    rng = random.Random(seed)
    alphabet = "abcdeéÉzÿ×"
    base = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(4, 9))) for _ in range(stems)]
    out = []
    for _ in range(rows):
        words = []
        for _ in range(40):
            w = rng.choice(base[: rng.choice([3, stems])])
            if rng.random() < 0.4:
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice(alphabet) + w[at:], w[:at] + rng.choice(alphabet) + w[at + 1 :]])
            words.append(w.upper() if rng.random() < 0.1 else w)
        out.append(rng.choice([" ", "1", "\n--"]).join(words))
    return out


@pytest.mark.parametrize(("sample", "block", "queries"), [(spelling.SAMPLE_WORDS, spelling.BLOCK_WORDS, spelling.QUERY_WORDS), (40, 6, 5), (10**6, 3, 4)])
def test_variants_equal_brute_force(spark, sample, block, queries):
    given = texts(7, 60, 250)
    rows = [(i, t, "x", 1, "y", "z") for i, t in enumerate(given)]
    long = "abcde" * 40000
    rows += [(900, None, None, None, None, None), (901, "", None, None, None, None), (None, given[0], None, None, None, None), rows[0], rows[0]]
    rows += [(i, f"{long} {long[:-1]}x ßßßßß aßßßßß \U0001d41b\U0001d41c", None, None, None, None) for i in (902, 903, 904, 905)]
    df = spark.createDataFrame(rows, KIND).repartition(5)
    found = spelling.variants(df, "doc_id", "text", sample, block, queries).select("word", "n", "n_near", "form", "form_n", "root").collect()
    assert len(found) == len(set(found)) and {tuple(r) for r in found} == brute(rows)
    assert any(r["form"] and r["root"] != r["form"] for r in found) and any(r["word"] == long for r in found)


def test_no_words(spark):
    df = spark.createDataFrame([(1, None), (2, "a b c 12345")], "doc_id long, text string")
    assert spelling.variants(df, "doc_id", "text").collect() == []
    assert spelling.variants(df.limit(0), "doc_id", "text").collect() == []


def test_equal_letter_counts_stay_in_bounded_blocks(spark):
    rng = random.Random(1)
    words = sorted({"".join(rng.sample("aaabbbccc", 9)) for _ in range(3000)})
    tree = spelling.Boxes(words, 1.0, 8)
    assert tree.boxes == 1
    df = spark.createDataFrame([(w, 3) for w in words], "word string, n long")
    found = spelling.near_words(df, tree, 50, 70).collect()
    assert found == []  # a replaced letter changes the counts
    more = words + [w[:4] + w[5:] for w in words]
    df = spark.createDataFrame([(w, 3) for w in sorted(set(more))], "word string, n long")
    found = {frozenset((r["word"], r["other"])) for r in spelling.near_words(df, spelling.Boxes(words[:5], 0.1, 8), 50, 70).collect()}
    known = sorted(set(more))
    assert found == {frozenset((a, b)) for i, a in enumerate(known) for b in known[:i] if one_edit(a, b)}


def test_search_leaves_nothing_out():
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abcdeé") for _ in range(6)) for _ in range(400)})
    longer = sorted({w[:2] + rng.choice("abé") + w[2:] for w in words} | {"".join(rng.choice("abcdeé") for _ in range(7)) for _ in range(200)})
    for queries, members in ((words, words), (words, longer)):
        x, y = spelling.near_pairs(queries, members, 4)
        assert sorted(zip(x.tolist(), y.tolist(), strict=True)) == [
            (i, j) for i, a in enumerate(queries) for j, b in enumerate(members) if one_edit(a, b)
        ]
    assert spelling.letter_counts(spelling.letters(["éab"])).sum() == 3 and np.array_equal(spelling.letters(["ab"])[0], [97, 98])
