"""Training-data operators against brute force, on small tables with awkward rows."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import oracle
import pytest
import xxhash
from pyspark.sql import functions as F

from rowloom.llm import (
    catalog,
    components,
    decontaminate,
    langid,
    mixing,
    sequences,
    simhash,
    substrings,
    tokens,
    topk,
    toxicity,
    urlfilter,
)
from rowloom.plans.catalog import Entry

DOCS = "doc_id long, text string, lang string, source string, n_tokens string, fingerprint int, size double"
WORDS = "alpha beta gamma delta omega sigma kappa lambda theta zeta".split()


def documents(spark):
    """Nulls in every column, empty, blank and long texts, repeated rows and ids, columns named like results."""
    rng = random.Random(3)
    passage = " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(60))
    long = " ".join(rng.choice(WORDS) + str(rng.randrange(900)) for _ in range(3000))
    texts = [None, "", " \n\t ", "!!! 123", "one", "two words", passage, passage + " tail", "head " + passage, long, long + " x"]
    texts += ["naïve café — ØRE <|endoftext|> a  b\n\nc", passage, "the the the the " * 30]
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 4 else None, "t", i, 0.5) for i, t in enumerate(texts)]
    rows += [rows[6], rows[6], (None, passage, None, None, None, None, None), (6, "other text", "en", "s1", None, 1, None)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark).cache()


@pytest.fixture(scope="module")
def vocabulary():
    return catalog.vocabulary()


@pytest.fixture(scope="module")
def duck(folder):
    connection = oracle.connect(folder)
    yield connection
    connection.close()


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, folder, duck, name):
    entry = Entry(name, catalog.QUERIES[name], catalog.SQL[name])
    assert oracle.differences(spark, folder, entry, duck) == []


# --- URL filter ----------------------------------------------------------------------------------


def test_urls_and_rules(spark):
    urls = [
        None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x?y", "http://example.com/en/", "http://a.example.com/en/1#x",
        "http://example.com/de/", "http://notexample.com?x", "http://x.net/es/1", "http://x.net/esx", "http://É.net/fr/é", "a://b://c/d",
    ]
    pages = spark.createDataFrame([(i, u, "<p>example words</p>" if i else None) for i, u in enumerate(urls)], "page_id long, url string, html string")
    found = {r["page_id"]: r for r in urlfilter.judge_urls(pages, "page_id", "url", "html", catalog.URL_RULES).collect()}
    assert len(found) == len(urls)
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host) :]).group()
        host = "".join(c.lower() if c.isascii() else c for c in host)
        best = None
        for rule, verdict in catalog.URL_RULES:
            name, start = rule.split("/", 1)
            if (host == name or host.endswith("." + name)) and path.startswith("/" + start):
                best = max(best or ("", ""), (rule, verdict), key=lambda x: len(x[0]))
        assert (found[i]["host"], found[i]["path"], found[i]["rule"]) == (host, path, best and best[0])
        assert found[i]["verdict"] == best[1] if best else found[i]["verdict"] in ("allow", "block")
    assert urlfilter.judge_urls(pages.limit(0), "page_id", "url", "html", catalog.URL_RULES).count() == 0


def test_viterbi_is_the_cheapest_split():
    counts = {"the": 50, "there": 20, "rein": 3, "in": 30, "re": 9, "her": 8, "spam": 5, "farm": 5}
    model = urlfilter.Segmenter(counts)
    assert model.split("spamfarm") == ("spam", "farm")
    assert "".join(model.split("xxtherein")) == "xxtherein"

    def cheapest(name):
        if not name:
            return 0.0
        return min(
            (model.cost.get(name[:n], model.unknown if n == 1 else math.inf) + cheapest(name[n:]) for n in range(1, len(name) + 1))
        )

    for name in ("therein", "herethe", "intherein"):
        assert math.isclose(sum(model.cost.get(w, model.unknown * len(w)) for w in model.split(name)), cheapest(name))


def test_naive_bayes_follows_the_rules(spark):
    rows = [(i, f"http://{'badcasino' if i % 2 else 'goodnews'}{i}.{'net/es' if i % 2 else 'com'}/x{i}", "<p>bad casino good news</p>" * 5) for i in range(60)]
    rows += [(100, "http://badcasino.org/x", None), (101, "http://goodnews.org/x", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r["page_id"]: r["verdict"] for r in urlfilter.judge_urls(pages, "page_id", "url", "html", catalog.URL_RULES).collect()}
    assert (found[100], found[101]) == ("block", "allow")


# --- SimHash -------------------------------------------------------------------------------------


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def brute_components(fps):
    tree = list(range(len(fps)))

    def find(x):
        while tree[x] != x:
            x = tree[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                tree[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_simhash_equals_brute_force(docs, rows):
    found = simhash.near_duplicates(docs, "doc_id", "text").withColumn("fingerprint", simhash.hex_fingerprint(F.col("fp")))
    given = [(r["doc_id"], brute_fingerprint(r["text"])) for r in docs.collect()]
    groups = brute_components([f for _, f in given])
    least = {g: min(k for (k, _), h in zip(given, groups, strict=True) if h == g and k is not None) for g in groups}
    expected = sorted(((k, f"{f:016x}", least[g]) for (k, f), g in zip(given, groups, strict=True)), key=repr)
    assert rows(found, "doc_id", "fingerprint", "component") == expected


@pytest.mark.parametrize("class_rows", [4, 1000])
def test_links_connect_crowded_segments(spark, class_rows):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(6)]
    fps = set(base)
    for b in base[:3]:
        for _ in range(60):
            x = b
            for _ in range(rng.randrange(6)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    links = [(r["x"] % (1 << 64), r["y"] % (1 << 64)) for r in simhash.near_links(df, class_rows=class_rows).collect()]
    assert all((x ^ y).bit_count() <= 3 for x, y in links)
    at = {x: i for i, x in enumerate(fps)}
    expected = brute_components(fps)
    tree = list(range(len(fps)))

    def find(x):
        while tree[x] != x:
            x = tree[x]
        return x

    for x, y in links:
        tree[find(at[x])] = find(at[y])
    same = {}
    for i, g in enumerate(expected):
        assert same.setdefault(g, find(i)) == find(i)
    assert len(set(same.values())) == len(same)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 140)] + [(7, 7), (None, 3)]
    found = components.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    assert {r["node"]: r["root"] for r in found} == {**dict.fromkeys(range(1, 41), 0), **dict.fromkeys(range(101, 140), 100)}


def test_one_of_each_keeps_columns_and_unnamed_rows(docs):
    kept = simhash.one_of_each(docs, "doc_id", "text")
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(None) == 1 and len(ids) == len(set(ids)) and 12 not in ids and 6 in ids


# --- tokens --------------------------------------------------------------------------------------


def awkward_texts():
    rng = random.Random(1)
    signs = [*"ab c\n\t.,'sS1²é日\u00a0\r\u2003  \n<|>\x1c\u200b", "<|endoftext|>", "'ll", " "]
    return ["".join(rng.choice(signs) for _ in range(rng.randrange(15))) for _ in range(3000)]


def test_tokens_are_the_library_s(vocabulary):
    from tokenizers import Tokenizer

    library, ours, counts = Tokenizer.from_file(vocabulary), tokens.RunCoder(vocabulary), tokens.RunCounter(vocabulary)
    for text in awkward_texts():
        expected = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ours.encode(text), ours.dtype).tolist() == expected
        assert counts.count(text) == len(expected)


def test_other_tokenizers_go_to_the_library(vocabulary):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    ours = tokens.RunCoder(path)
    assert not ours.splits
    for text in ("Hello  World\n", "", "é <|endoftext|> x"):
        expected = ours.library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ours.encode(text), ours.dtype).tolist() == expected


def test_token_counts(docs, vocabulary, rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary)
    expected = [(r["doc_id"], len(library.encode(r["text"] or "", add_special_tokens=False).ids)) for r in docs.collect()]
    assert rows(tokens.count_tokens(docs, "text", vocabulary, ["doc_id"])) == sorted(expected, key=repr)
    assert tokens.count_tokens(docs.limit(0), "text", vocabulary, ["doc_id"]).count() == 0


@pytest.mark.parametrize("length", [8, 2048])
def test_sequences_round_trip(spark, docs, vocabulary, length, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary)
    manifest = sequences.write_sequences(docs, "doc_id", "text", vocabulary, str(tmp_path), length)
    found = sequences.read_documents(manifest, "doc_id", "bigint").orderBy("start").collect()
    assert [r["doc_id"] for r in found] == sorted((r["doc_id"] for r in docs.collect()), key=lambda k: (k is not None, k or 0))
    assert [r["start"] for r in found] == np.cumsum([0] + [r["n_tokens"] for r in found[:-1]]).tolist()
    checks = Counter()
    for r in docs.collect():
        ids = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        checks[r["doc_id"], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in found) == checks
    for r in manifest.collect():
        file = sequences.SequenceFile.open(r["path"] + ".data.arrow")
        parts = [file.sequence(i) for i in range(r["n_sequences"])]
        assert all(len(ids) == length and len(mask) == length for ids, mask in parts)
        assert sum(sum(mask.to_pylist()) for _, mask in parts) == r["n_ids"]
        assert np.concatenate([i for i, _ in parts])[: r["n_ids"]].tolist() == np.concatenate(list(file.ids(0, r["n_ids"]))).tolist()
    assert sequences.encode_to_files(docs.limit(0), "doc_id", "text", vocabulary).count() == 0


# --- mixing --------------------------------------------------------------------------------------


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, left, free = {}, 1.5 * sum(sizes.values()), set(order)
    while free:
        price = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * price > 2 * sizes[s]}
        if not over:
            return target | {s: weight[s] * price for s in free}
        target |= {s: 2 * sizes[s] for s in over}
        left -= sum(2 * sizes[s] for s in over)
        free -= over
    return target


def test_mix_meets_targets(spark, docs):
    light = docs.select("doc_id", "source", mixing.n_words(F.col("text")).alias("words"))
    found = mixing.mix(light, "doc_id", "words", "source").collect()
    assert len(found) == docs.count()
    sizes, taken = Counter(), Counter()
    for r in found:
        sizes[r["source"]] += r["words"]
        taken[r["source"]] += r["words"] * (r["copies"] + r["extra"])
        assert 0 <= r["copies"] + r["extra"] <= 2
    targets = brute_targets(sizes)
    for r in found:
        assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], targets[r["source"]])
    again = mixing.mix(light.repartition(5), "doc_id", "words", "source").collect()
    assert Counter(map(tuple, found)) == Counter(map(tuple, again))
    assert mixing.mix(light.limit(0), "doc_id", "words", "source").count() == 0


def test_long_groups_are_ranked_in_buckets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANKED", 16)
    docs = spark.range(3000).select(
        F.col("id").alias("k"), F.when(F.col("id") % 3 == 0, "b").otherwise("a").alias("s"), (F.col("id") % 2 + 7).alias("n")
    )
    found = mixing.mix(docs, "k", "n", "s").collect()
    assert len({r["k"] for r in found}) == 3000
    for source in "ab":
        mine = [r for r in found if r["s"] == source]
        assert abs(sum(r["n"] * (r["copies"] + r["extra"]) for r in mine) - mine[0]["target"]) <= 1


def test_fit_is_exact_where_a_sum_is():
    rng = np.random.default_rng(2)
    for _ in range(50):
        lengths = np.unique(rng.integers(1, 60, 8))
        counts = rng.integers(1, 6, len(lengths))
        budget = int(rng.integers(0, (lengths * counts).sum() + 1))
        taken = mixing.fit(lengths, counts, budget)
        assert (taken >= 0).all() and (taken <= counts).all()
        sums = {0}
        for n, c in zip(lengths.tolist(), counts.tolist(), strict=True):
            sums = {s + k * n for s in sums for k in range(c + 1)}
        best = max(s for s in sums if s <= budget)
        assert best - lengths.max() <= (lengths * taken).sum() <= budget
        assert (lengths * mixing.knapsack(lengths, counts, budget)).sum() == best


def test_fit_with_very_long_documents():
    import time

    rng = random.Random(2)
    for lengths in ([1_000_000, 700_001, 3, 1], [*rng.sample(range(1, 2_000_000), 1500)], [3_000_000] * 2, [50_000, 49_999, 33_000]):
        lengths = np.array(sorted(set(lengths)))
        counts = np.array([rng.randrange(1, 6) for _ in lengths])
        have = int((lengths * counts).sum())
        for share in (0.1, 0.5, 0.97):
            begin = time.perf_counter()
            taken = mixing.fit(lengths, counts, int(have * share))
            assert time.perf_counter() - begin < 30 and (0 <= taken).all() and (taken <= counts).all()
            got = int((lengths * taken).sum())
            assert got <= have * share and have * share - got < max(lengths.min() * 2, lengths.max() * 0.6)
    # with short documents at hand the words come out exactly
    taken = mixing.fit(np.array([1, 2, 100_000]), np.array([60_000, 50_000, 30]), 1_234_567)
    assert (taken * np.array([1, 2, 100_000])).sum() == 1_234_567


def test_mixed_rows_are_repeated(docs):
    light = docs.select("doc_id", "source", mixing.n_words(F.col("text")).alias("words"))
    expected = Counter()
    for r in mixing.mix(light, "doc_id", "words", "source").collect():
        expected[r["doc_id"], r["words"]] += r["copies"] + r["extra"]
    found = mixing.mixed_rows(docs, "doc_id", "text", "source")
    assert found.columns == docs.columns
    got = Counter((r["doc_id"], r["words"]) for r in found.select("doc_id", mixing.n_words(F.col("text")).alias("words")).collect())
    assert got == +expected


# --- top-k ---------------------------------------------------------------------------------------


@pytest.mark.parametrize("shard_rows", [3, 4096])
def test_top_k_equals_brute_force(spark, shard_rows):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(8)]) for i in range(60)]
    rows += [(0, rows[0][1]), (5, rows[0][1]), (None, rows[0][1]), (70, None), (10, []), (20, [0.5])]
    rows += [(50, [1.0, None]), (100, [float("nan")] * 8), (150, [float("inf")]), (200, [-0.001] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = topk.nearest(df, "vec_id", "embedding", every=5, shard_rows=shard_rows).collect()
    usable = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    expected = []
    for q, (qid, qv) in enumerate(usable):
        if qid is None or qid % 5:
            continue
        scored = [(-sum(a * b for a, b in zip(qv, cv, strict=False)), cid is None, cid or 0, cid) for c, (cid, cv) in enumerate(usable) if c != q]
        expected += [(qid, n, x[3], -x[0]) for n, x in enumerate(sorted(scored)[:5], 1)]
    assert sorted(map(tuple, found), key=repr) == sorted(expected, key=repr)
    assert topk.nearest(df.limit(0), "vec_id", "embedding", every=5).count() == 0


def test_top_k_of_components_of_any_size(spark):
    """Scores beyond 64 bits are ranked exactly and shown as the nearest long."""
    rng = random.Random(6)
    large = [0.0, 1.0, -3.5, 1e9, -1e9, 2.0**40, 3.7e15, -1e30, 1e300, -1.7e308, 5e-324]
    rows = [(i, [rng.choice(large) for _ in range(3)]) for i in range(40)] + [(50, [1e9, 1.0]), (51, [1e9, 1.0]), (60, [0.25] * 3)]
    wide = [(100 + i, [rng.choice([900_000.0, -900_000.0, 0.5]) for _ in range(200)]) for i in range(20)]
    for given, size in ((rows, 4), (rows, 4096), (wide, 7)):
        df = spark.createDataFrame(given, "vec_id long, embedding array<double>")
        found = topk.nearest(df, "vec_id", "embedding", every=5, shard_rows=size).collect()
        exact = {i: [int(x) * 256 if abs(x) > 2**60 else math.floor(256 * x) for x in v] for i, v in given}
        expected = []
        for q in exact:
            scored = sorted((-sum(a * b for a, b in zip(exact[q], v, strict=False)), i) for i, v in exact.items() if i != q)
            expected += [(q, n, i, max(-(2**63), min(2**63 - 1, -x))) for n, (x, i) in enumerate(scored[:5], 1) if q % 5 == 0]
        assert sorted(map(tuple, found)) == sorted(expected)


def test_sortable_scores():
    values = [0, 1, -1, 255, 256, -255, -256, 2**63, -(2**63), 10**40, -(10**40)]
    assert sorted(values, key=topk.sortable) == sorted(values)


# --- decontamination -----------------------------------------------------------------------------


def brute_overlap(text, items):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))

    mine, hit, names = words(text), set(), set()
    for item, body in items:
        theirs = words(body)
        n = min(13, len(theirs))
        windows = {tuple(theirs[i : i + n]) for i in range(len(theirs) - n + 1)} if n else set()
        for i in range(len(mine) - n + 1):
            if tuple(mine[i : i + n]) in windows:
                hit.update(range(i, i + n))
                names.add("null" if item is None else str(item))
    return len(mine), len(hit), tuple(sorted(names))


@pytest.mark.parametrize("block_words", [10, 10**6])
def test_overlaps_equal_brute_force(spark, docs, block_words):
    texts = [r["text"] for r in docs.collect()]
    items = [(10, " ".join(texts[6].split()[5:25])), (9, "one"), (None, "TWO words"), (11, ""), (12, None), (13, texts[9][100:400]), (10, "the the")]
    table = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.overlaps(docs, "text", table, "item_id", "text", ["doc_id"], block_words=block_words)
    got = Counter((r[0], r[1], r[2], tuple(r[3])) for r in found.select("doc_id", "n_words", decontaminate.n_hit(), "items").collect())
    assert got == Counter((r["doc_id"], *brute_overlap(r["text"], items)) for r in docs.collect())
    clean = decontaminate.clean_rows(docs, "text", table, "item_id", "text")
    assert clean.columns == docs.columns
    assert clean.count() == sum(1 for t in texts for n, h, _ in [brute_overlap(t, items)] if not (h and 20 * h >= n))
    assert decontaminate.clean_rows(docs, "text", table.limit(0), "item_id", "text").count() == len(texts)


# --- repeated passages ---------------------------------------------------------------------------


def test_every_shift_meets_the_cover():
    cover = set(substrings.COVER)
    for d in range(substrings.PERIOD):
        assert any((a + d) % substrings.PERIOD in cover for a in cover)


def test_repeats_equal_brute_force(docs):
    texts = [(r["doc_id"], re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in docs.collect()]
    seen = Counter(tuple(w[i : i + 35]) for _, w in texts for i in range(len(w) - 34))
    expected = Counter()
    for key, w in texts:
        gone = {j for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        expected[key, len(w), len(gone), sha256(kept.encode()).hexdigest()] += 1
    found = substrings.remove_repeats(docs, "doc_id", "text").drop("kept")
    assert Counter(map(tuple, found.collect())) == expected
    assert substrings.remove_repeats(docs.limit(0), "doc_id", "text").count() == 0


# --- classifiers ---------------------------------------------------------------------------------


def test_language_accuracy_and_rejection(spark, folder, docs):
    table = catalog.table(spark, folder, "documents")
    model = catalog.language_model(table)
    held = table.where(catalog.held_out())
    right = langid.predict_languages(held, model, "text", ["lang"]).agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.9
    found = langid.predict_languages(docs, model, "text", ["doc_id", "text"]).collect()
    for r in found:
        assert 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (r["text"] is None or not any(map(str.isalpha, r["text"])))
    kept = langid.accepted(docs, model, "text")
    assert kept.columns == docs.columns and kept.where("text IS NULL").count() == 0
    empty = langid.fit_languages(docs.limit(0), "doc_id", "text", "lang")
    assert langid.predict_languages(docs, empty, "text", ["doc_id"]).where("lang_pred <> 'und'").count() == 0


def test_pieces_of_long_texts_add_up(monkeypatch):
    table = np.random.default_rng(1).normal(size=(langid.BUCKETS, 3))
    texts = [langid.prepare(t) for t in ("Ein langer Text " * 40, "", "kurz", "über alles " * 30)]
    whole = langid.text_sums(texts, table)
    monkeypatch.setattr(langid, "PIECE_BYTES", 37)
    parts = langid.text_sums(texts, table)
    assert np.allclose(whole[0], parts[0]) and (whole[1] == parts[1]).all()


def test_rejection_of_texts_in_no_learned_language():
    import pyarrow.parquet as pq

    strange = [
        "这是一个用中文写的句子，它应该被拒绝。我们不认识这种语言。", "Это предложение написано по-русски и должно быть отклонено.",
        "Το ελληνικό κείμενο εδώ είναι άγνωστο σε εμάς", "これは日本語の文章です、知らない言葉です", "zxcvbnm qwrtpsdfg hjklmn bvcxz wrtplk qqqq xxxx",
        "הטקסט הזה כתוב בעברית ולא באחת השפות", "x̶̷̸" * 30,
    ]
    for sf in ("sf0.001", "sf0.01"):
        rows = pq.read_table(f"/root/testdata/{sf}/documents.parquet").to_pylist()
        model = langid.train([(r["lang"], r["text"][:2000]) for r in rows if r["doc_id"] % 4])
        held = [r["text"] for r in rows if not r["doc_id"] % 4]
        assert sum(model.judge(held)[2]) >= 0.995 * len(held), sf
        assert not any(model.judge(strange)[2]), sf


def test_softmax_training_against_plain_gradients():
    """The means, logits and probabilities of a model are those of counting n-grams one by one."""
    model = langid.train([("a", "xyz xyzz"), ("b", "ubu bubu")] * 10)
    text = "xyz bubu"
    grams = [g for n in (3, 4) for w in f" {text} ".split(" ")[1:-1] for g in [f" {w} ".encode()[i : i + n] for i in range(len(w) + 3 - n)]]
    rows = []
    for g in grams:
        data = np.frombuffer(g, np.uint8)
        found = [b for _, b in langid.gram_buckets(data, (len(g),))][0]
        rows.append(model.table[found[0]])
    logits = np.mean([r[:-1] for r in rows], axis=0) + model.bias
    chance = np.exp(logits / model.temperature - (logits / model.temperature).max())
    name, score = model.predict([text])
    assert score[0] == pytest.approx((chance / chance.sum()).max(), rel=1e-4) and name[0] == model.languages[int(chance.argmax())]


def test_toxicity_with_clashing_columns_and_contradicting_labels(spark):
    schema = "doc_id long, text string, toxic string, low_quality int, flagged double, p_toxic string, __key string"
    rows = [(i, f"bad{i % 5} words here" if i % 3 == 0 else f"good{i} words there", "x", 1, 0.5, None, "k") for i in range(90)]
    rows += [(3, "another text", None, None, None, None, None)] * 400 + [(None, "no key", None, None, None, None, None), (5, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, schema)
    labels = [(i, 0, int(i % 3 == 0)) for i in range(90)] + [(0, 0, 0), (1, 1, 1), (None, 1, 1), (2, None, 1)]
    marked = spark.createDataFrame(labels, "doc_id long, low_quality int, toxic int")
    first = toxicity.fit_chain(docs, marked, "doc_id", "text", ["low_quality", "toxic"])
    again = toxicity.fit_chain(docs.repartition(7), marked.orderBy("toxic"), "doc_id", "text", ["low_quality", "toxic"])
    assert all(np.array_equal(a.weights, b.weights) and a.bias == b.bias for a, b in zip(first.models, again.models, strict=True))
    found = toxicity.score_toxicity(docs, first, "text", ["doc_id"])
    assert found.columns == ["doc_id", "p_low_quality", "p_toxic", "flagged"] and found.count() == len(rows)


def test_chain_equals_plain_arithmetic(spark):
    """Probabilities of a chain, summed feature by feature in plain Python."""
    texts = [f"alpha beta {w}" for w in ("nasty", "kind", "rude", "calm")] * 15
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 2), int(i % 2 == 0)) for i in range(60)], "doc_id long, a int, b int")
    chain = toxicity.fit_chain(docs, labels, "doc_id", "text", ["a", "b"])
    for r in toxicity.score_toxicity(docs, chain, "text", ["text"]).distinct().collect():
        earlier = []
        for model in chain.models:
            total = model.bias + sum(float(model.weights[f]) for f in toxicity.features(r["text"])) + sum(x * w for x, w in zip(earlier, model.earlier, strict=True))
            earlier.append(1 / (1 + math.exp(-max(-30, min(30, total)))))
        assert [r["p_a"], r["p_b"]] == pytest.approx(earlier, rel=1e-9)


def test_naive_bayes_of_urls_equals_counting(spark):
    urls = [f"http://{'shop' if i % 3 else 'news'}{i % 4}.example.com/{'en' if i % 2 else 'de'}/{i % 7}" for i in range(60)]
    urls += [f"https://news.site.org/{w}" for w in ("en/1", "de/2", "shop")] + [None, "none", urls[0]]
    pages = spark.createDataFrame([(i, u, "<p>shop news example site</p>", "x") for i, u in enumerate(urls)], "page_id long, url string, html string, verdict string")
    rules = [("com/", urlfilter.ALLOW), ("example.com/en/", urlfilter.BLOCK)]
    found = {r["page_id"]: r for r in urlfilter.judge_urls(pages, "page_id", "url", "html", rules).collect()}
    words = Counter(w for _ in urls for w in ("shop", "news", "example", "site"))
    split = urlfilter.Segmenter(dict(words)).split
    bags = {}
    for i, r in found.items():
        splits = {run: list(split(run)) for run in re.findall("[a-z]+", r["host"] or "")}
        bags[i] = [urlfilter.bucket(t) for t in urlfilter.tokens(r["host"] or "", r["path"] or "", splits)]
    ruled = {i: r["verdict"] for i, r in found.items() if r["rule"]}
    counts = {v: Counter(t for i, x in ruled.items() if x == v for t in bags[i]) for v in (urlfilter.ALLOW, urlfilter.BLOCK)}
    seen = len({*counts["allow"], *counts["block"]})
    number = Counter(ruled.values())
    for i, r in found.items():
        odds = math.log((number["block"] + 1) / (number["allow"] + 1))
        for t in bags[i]:
            if counts["allow"][t] + counts["block"][t]:
                share = [(counts[v][t] + urlfilter.SMOOTHING) / (sum(counts[v].values()) + urlfilter.SMOOTHING * seen) for v in ("block", "allow")]
                odds += math.log(share[0] / share[1])
        assert r["block_odds"] == pytest.approx(odds), r
        if not r["rule"]:
            assert r["verdict"] == ("block" if odds > 0 else "allow")


def test_frequent_words_are_counted_without_a_shuffle(spark, docs, vocabulary):
    table = tokens.frequent_lengths(docs, "text", vocabulary)
    plain = Counter(w for r in docs.collect() for line in (r["text"] or "").split("\n") for w in line.split(" ")[1:] if 0 < len(w) <= 32)
    assert set(table) <= set(plain) and {"the", "x"} <= set(table)
    plan = tokens.count_tokens(docs, "text", vocabulary, ["doc_id"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_toxicity_chain_on_planted_words(spark):
    rng = random.Random(6)
    bad = ["wretchedfool", "vileskunk"]
    rows, labels = [], []
    for i in range(900):
        words = [rng.choice(WORDS) + rng.choice(WORDS) for _ in range(rng.randrange(5, 60))]
        toxic = i % 5 == 0
        if toxic:
            words[rng.randrange(len(words))] = bad[i % 2]
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic or i % 7 == 0), int(toxic)))
    labels += [(None, 1, 1), (3, None, 0), (9999, 1, 1)]
    docs = spark.createDataFrame([*rows, (None, None), (2000, "")], "doc_id long, text string")
    marked = spark.createDataFrame(labels, "doc_id long, low_quality int, toxic int").where("doc_id IS NULL OR doc_id % 3 > 0")
    chain = toxicity.fit_chain(docs, marked, "doc_id", "text", ["low_quality", "toxic"])
    found = toxicity.score_toxicity(docs, chain, "text", ["doc_id"]).collect()
    assert len(found) == 902
    for r in found:
        if r["doc_id"] is not None and r["doc_id"] < 900 and r["doc_id"] % 3 == 0:
            assert r["flagged"] == (r["doc_id"] % 5 == 0)
    assert not any(r["flagged"] for r in found if r["doc_id"] in (None, 2000))
    nothing = toxicity.fit_chain(docs, marked.limit(0), "doc_id", "text", ["toxic"])
    assert toxicity.score_toxicity(docs, nothing, "text", ["doc_id"]).where("flagged").count() == 0
