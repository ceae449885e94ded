"""Host names are split with all words of the pages, however rare or long."""

from __future__ import annotations

from rowloom.llm import urlfilter


def test_rare_and_long_words_split_hosts(spark):
    long = "pneumonoultramicroscopicsilicovolcanoconiosis"
    letters = "abcdefghij"
    common = " ".join(f"{a}{b}{c}{d}q" for a in letters for b in letters for c in letters for d in letters)
    more = common.replace("q", "z") + " " + common.replace("q", "y")
    pages = spark.createDataFrame([(f"{common} {common} {more} {more}",), (f"zebra <b>{long}</b> crossing",)], "html string")
    words = urlfilter.page_words(pages, "html")
    hosts = spark.createDataFrame([("zebracrossing.x",), (f"my{long}zebra.zebracrossing.42",), ("",), ("1.2",)], "host string")
    found = {r["host"]: {s["run"]: s["words"] for s in r["splits"]} for r in urlfilter.host_splits(hosts, words).collect()}
    assert found["zebracrossing.x"] == {"zebracrossing": ["zebra", "crossing"], "x": ["x"]}
    assert found[f"my{long}zebra.zebracrossing.42"][f"my{long}zebra"] == ["my", long, "zebra"]
    assert set(found) == {"zebracrossing.x", f"my{long}zebra.zebracrossing.42"}
    counts = {r["word"]: r["count"] for r in words.collect()}
    assert len(counts) == 30_003
    whole = urlfilter.Segmenter(counts)
    assert all(tuple(w) == whole.split(run) for splits in found.values() for run, w in splits.items())
