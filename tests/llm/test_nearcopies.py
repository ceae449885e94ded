"""Near copies of the pipeline against brute force over all pairs."""

from __future__ import annotations

import random

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from rowloom import session
from rowloom.llm import catalog, nearcopies


def shingles(text):
    words = (text or "").lower().split()
    return frozenset(" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(texts):
    """The smallest place that pairs of a similarity of 0.8 reach, for every text."""
    sets, tree = [shingles(t) for t in texts], list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if tree[i] != tree[j] and len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                low, high = sorted((tree[i], tree[j]))
                tree = [low if x == high else x for x in tree]
    return tree


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("class_rows", [8, nearcopies.CLASS_ROWS])
def test_components_equal_brute_force(spark, class_rows):
    rng = random.Random(4)
    texts = [None, "", "one", "One", "two words"]
    for group in range(12):
        base = [f"w{rng.randrange(5000)}" for _ in range(200)]
        texts += [edited(rng, base, rng.randrange(6)) for _ in range(40 if group < 2 else 4)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n long, text string")
    found = {r["key"]: r["component"]["key"] for r in nearcopies.near_copies(df, "n", "text", class_rows)[0].collect()}
    assert [found[i] for i in range(len(texts))] == brute(texts)


def test_stage_drops_a_near_copy_beyond_three_bits(spark, folder):
    words = [f"w{i}" for i in range(250)]
    texts = [" ".join(words), " ".join([*words[:100], "x", "y", *words[102:]]), " ".join([*words[:100], *["z"] * 60, *words[160:]])]
    schema = catalog.table(spark, folder, "documents").schema
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    docs = docs.select(*[F.col(f.name) if f.name in docs.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema])
    kept = dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs, folder)
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 2]


def test_stage_equals_brute_force_on_documents(spark, folder):
    docs = catalog.table(spark, folder, "documents")
    given = sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())
    kept = dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs, folder)
    assert {r["doc_id"] for r in kept.collect()} == {given[i][0] for i in brute([t for _, t in given])}


def test_every_group_keeps_a_row(spark):
    texts = [" ".join(f"{mark}{i}" for i in range(60)) for mark in "abc"]
    rows = [(5, texts[0]), (5, texts[1]), (9, texts[1]), (None, texts[2]), (None, texts[2]), (None, texts[0]), (7, None), (8, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = nearcopies.one_of_each(df, "doc_id", "text").collect()
    assert sorted(map(tuple, kept), key=repr) == sorted([(5, texts[0]), (5, texts[1]), (None, texts[2]), (7, None)], key=repr)


def test_links_of_a_large_group_grow_with_its_members(spark):
    """A planted group of 2,000 different near copies, dealt into many classes: recall against brute force, and links."""
    rng = random.Random(9)
    base = [f"w{rng.randrange(5000)}" for _ in range(220)]
    texts = [edited(rng, base, rng.randrange(1, 4)) for _ in range(2000)]
    truth = brute(texts)
    made = {}
    for size in (1000, 2000):
        df = spark.createDataFrame(list(enumerate(texts[:size])), "n long, text string")
        found = {r["key"]: r["component"]["key"] for r in nearcopies.near_copies(df, "n", "text", 256)[0].collect()}
        made[size] = found
    kept, stay = len(set(truth)), len(set(made[2000].values()))
    # every component found lies within a true one
    assert all(truth[i] == truth[found] for i, found in made[2000].items())
    assert 2000 - stay >= 0.97 * (2000 - kept)

    sketches = [nearcopies.least_values(nearcopies.shingle_set(t)).astype(np.uint8) for t in texts]
    links = nearcopies.spanning_trees(np.array(sketches))
    assert len(links) <= 3 * (len(texts) - 1)


def test_prefixes_find_what_both_searches_miss(spark, monkeypatch):
    """A group in tiny classes, common shingles at the end of the order or not: the components are those of all pairs."""
    rng = random.Random(11)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    texts = [edited(rng, base, rng.randrange(1, 4)) for _ in range(300)]
    texts += [edited(rng, texts[-1].split(), 2) for _ in range(40)] + [None, "two words"]
    df = spark.createDataFrame(list(enumerate(texts)), "n long, text string")
    truth = brute(texts)
    for share in (1, 16):
        monkeypatch.setattr(nearcopies, "COMMON_SHARE", share, raising=False)
        found = {r["key"]: r["component"]["key"] for r in nearcopies.near_copies(df, "n", "text", 2)[0].collect()}
        assert [found[i] for i in range(len(texts))] == truth


def test_near_misses_of_a_group_meet_in_blocks(spark, monkeypatch):
    """Texts just below the similarity and a group above it: components of all pairs, and few pairs meet one by one."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]
    texts = [edited(rng, base, 2) for _ in range(300)] + [edited(rng, base, 1) for _ in range(80)]
    proposed, verified = [], nearcopies.verified

    def counted(links, *args):
        proposed.append(links.count())
        return verified(links, *args)

    monkeypatch.setattr(nearcopies, "verified", counted)
    df = spark.createDataFrame(list(enumerate(texts)), "n long, text string")
    truth = brute(texts)
    for limits in ({}, {"CROWD_ROWS": 8, "CLASS_ROWS": 32}, {"CROWD_ROWS": 8, "BLOCK_SHINGLES": 1000}):
        for name, value in limits.items():
            monkeypatch.setattr(nearcopies, name, value, raising=False)
        found = {r["key"]: r["component"]["key"] for r in nearcopies.near_copies(df, "n", "text", 4)[0].collect()}
        assert [found[i] for i in range(len(texts))] == truth
        assert proposed[-1] <= 10 * len(texts)


def test_no_texts_stay_written(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "scratch_root", lambda _: str(tmp_path))
    rows = [(i, " ".join(f"t{i % 7}x{j}" for j in range(400))) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert nearcopies.one_of_each(df, "doc_id", "text").count() == 7
    columns = {c for p in (tmp_path / "rowloom").rglob("*.parquet") for c in spark.read.parquet(f"file://{p}").columns}
    assert not columns & {"text", "sketch", "bands"}
