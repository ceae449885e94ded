"""URL filtering: host rules first, then naive Bayes over segmented names.

Host names run words together. A unigram model of the pages' own words splits each part of a host by Viterbi into the
likeliest words; those and the tokens of the path are what a multinomial naive Bayes model scores. It learns from the
URLs that a rule settles and judges the others.

Word counts and class counts are aggregates over all pages. Words of any count and length take part: the pieces of each
different letter run of the hosts meet the word counts in a join, and a run is split with the words it can use. What is
broadcast has a fixed size: a table of log odds with a fixed number of hash buckets.
"""

from __future__ import annotations

import re
from functools import lru_cache
from math import log

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from rowloom.llm.slices import map_slices
from rowloom.session import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ALLOW, BLOCK = "allow", "block"
# Pieces of a run up to so many letters meet the words as they are; longer words are found by their first letters.
PIECE_LETTERS = 24
BUCKETS = 1 << 16
SMOOTHING = 1.0

_SPLIT = re.compile(r"[a-z\u0080-\U0010ffff]+|[0-9]+")


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://`` up to ``/``, ``?``, ``#``; A-Z lower-cased) and path (then up to ``?`` or ``#``).

    Both are empty for a null URL and for one without ``://``.
    """
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does.

    A rule ``name/start`` fits the host ``name`` and all its subdomains, where the path starts with ``/start``. Of two
    rules of one length the first in code-point order counts.
    """
    rule = verdict = F.lit(None).cast("string")
    for text, decision in sorted(rules, key=lambda r: (len(r[0]), [-ord(c) for c in r[0]])):
        name, _, start = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + start)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, decision).otherwise(verdict)
    return rule, verdict


def page_words(pages: DataFrame, html: str) -> DataFrame:
    """``word`` and ``count`` of all words of all pages, tags left out."""
    text = F.regexp_replace(F.translate(F.col(html), UPPER, LOWER), "<[^>]*>", " ")
    words = pages.select(F.explode(F.split(text, r"[^a-z\u0080-\uffff]+")).alias("word"))
    return words.where(F.length("word") > 0).groupBy("word").count()


def run_words(runs: DataFrame, words: DataFrame) -> DataFrame:
    """``id`` and the ``words`` (with counts) that occur anywhere in the ``run`` of that id; no row without words."""
    starts = runs.select("id", F.explode(F.sequence(F.lit(1), F.length("run"))).alias("at"), "run")
    heads = starts.select("id", "at", F.col("run").substr(F.col("at"), F.lit(PIECE_LETTERS)).alias("head"))
    sizes = F.sequence(F.lit(1), F.length("head"))
    pieces = heads.select("id", F.explode(F.transform(sizes, lambda n: F.col("head").substr(F.lit(1), n))).alias("word"))
    short = pieces.distinct().join(words, "word").select("id", "word", "count")
    long = words.where(F.length("word") > PIECE_LETTERS).withColumn("head", F.substring("word", 1, PIECE_LETTERS))
    long = heads.where(F.length("head") == PIECE_LETTERS).join(long, "head").join(runs, "id")
    long = long.where(F.col("run").substr(F.col("at"), F.length("word")) == F.col("word")).select("id", "word", "count")
    return short.union(long.distinct()).groupBy("id").agg(F.collect_list(F.struct("word", "count")).alias("words"))


def host_splits(hosts: DataFrame, words: DataFrame) -> DataFrame:
    """``host`` and ``splits``: each of its different letter ``run``s with the ``words`` of its likeliest split."""
    shared = words.agg(F.sum("count")).first()[0] or 1
    found = F.regexp_extract_all("host", F.lit(r"([a-z\u0080-\x{10ffff}]+)"), F.lit(1))
    named = hosts.select("host", F.explode(F.array_distinct(found)).alias("run"))
    runs = materialize(named.select("run").distinct().withColumn("id", F.monotonically_increasing_id()), "runs")
    known = runs.join(run_words(runs, words), "id", "left").select("run", "words")

    def start():
        def work(part):
            rows = zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)
            splits = [Segmenter({w["word"]: w["count"] for w in own or ()}, shared).split(run) for run, own in rows]
            return {"run": part.column(0), "words": [list(x) for x in splits]}

        return work

    split = map_slices(known, "run string, words array<string>", start, "run")
    return named.join(split, "run").groupBy("host").agg(F.collect_list(F.struct("run", "words")).alias("splits"))


class Segmenter:
    """The likeliest split of a name into words under a unigram model, by Viterbi."""

    def __init__(self, counts: dict[str, int], total: int | None = None):
        """``total`` counts all words, where ``counts`` holds only those that the names can use."""
        total = total or sum(counts.values()) or 1
        self.cost = {w: log(total / n) for w, n in counts.items()}
        self.longest = max(map(len, counts), default=1)
        # A letter run that is no word costs more than any word, and more the longer it is.
        self.unknown = log(total) + 2.0
        self.split = lru_cache(maxsize=100_000)(self._split)

    def _split(self, name: str) -> tuple[str, ...]:
        best, back = [0.0], [0]
        for end in range(1, len(name) + 1):
            cost, start = best[end - 1] + self.unknown, end - 1
            for begin in range(max(0, end - self.longest), end):
                known = self.cost.get(name[begin:end])
                if known is not None and best[begin] + known < cost:
                    cost, start = best[begin] + known, begin
            best.append(cost)
            back.append(start)
        words, end = [], len(name)
        while end:
            words.append(name[back[end] : end])
            end = back[end]
        # Single letters next to each other that no word explains are one unknown word.
        merged: list[str] = []
        odd = False
        for word in reversed(words):
            unknown = word not in self.cost
            if unknown and odd:
                merged[-1] += word
            else:
                merged.append(word)
            odd = unknown
        return tuple(merged)


def tokens(host: str, path: str, splits: dict[str, list[str]]) -> list[str]:
    """Marked words of host and path; digits count as one token whatever they are."""
    found = []
    for mark, text in (("h:", host), ("p:", path.lower())):
        for run in _SPLIT.findall(text):
            if run[0].isdigit():
                found.append(mark + "0")
            else:
                found.extend(mark + w for w in (splits[run] if mark == "h:" else (run,)))
    return found


def bucket(token: str) -> int:
    return xxhash.xxh32_intdigest(token.encode("utf-8", "replace")) % BUCKETS


def url_tokens(urls: DataFrame, words: DataFrame, keep: list[str], host: str, path: str) -> DataFrame:
    """The columns ``keep`` and the token buckets of every row."""
    splits = host_splits(urls.select(F.col(host).alias("host")).distinct(), words)
    joined = urls.select(*keep).join(splits.withColumnRenamed("host", "__host"), F.col(host) == F.col("__host"), "left")
    kind = urls.select(*keep).schema.add("buckets", ArrayType(IntegerType()))
    places = keep.index(host), keep.index(path), len(keep)

    def start():
        def work(part):
            rows = zip(*(part.column(i).to_pylist() for i in places), strict=True)
            found = [tokens(h or "", p or "", {x["run"]: x["words"] for x in s or ()}) for h, p, s in rows]
            buckets = [[bucket(t) for t in x] for x in found]
            return {**{c: part.column(i) for i, c in enumerate(keep)}, "buckets": buckets}

        return work

    return map_slices(joined.select(*keep, "splits"), kind, start)


def log_odds(labelled: DataFrame, verdict: str) -> tuple[float, np.ndarray]:
    """Multinomial naive Bayes as the prior and per-bucket log odds of ``block`` against ``allow``, over all rows."""
    priors, counts = {}, np.zeros((2, BUCKETS))
    # a null bucket per row counts the rows of each verdict
    marked = F.concat("buckets", F.array(F.lit(None).cast("int")))
    for r in labelled.select(verdict, F.explode(marked).alias("bucket")).groupBy(verdict, "bucket").count().collect():
        if r["bucket"] is None:
            priors[r[verdict]] = r["count"]
        else:
            counts[int(r[verdict] == BLOCK), r["bucket"]] = r["count"]
    seen = max(1, int((counts.sum(axis=0) > 0).sum()))
    share = np.log((counts + SMOOTHING) / (counts.sum(axis=1, keepdims=True) + SMOOTHING * seen))
    odds = np.where(counts.sum(axis=0) > 0, share[1] - share[0], 0.0)
    return log((priors.get(BLOCK, 0) + 1) / (priors.get(ALLOW, 0) + 1)), odds


def judge_urls(pages: DataFrame, key: str, url: str, html: str, rules: list[tuple[str, str]]) -> DataFrame:
    """``key``, ``host``, ``path``, ``rule``, ``verdict`` and ``block_odds`` (log odds of the model) for every row.

    The verdict is the rule's where one fits, else the model's: block where its log odds are above zero. A null URL
    has neither host nor path and is judged by the prior alone. Without any rule that fits, everything is allowed.
    """
    shared = pages.sparkSession.sparkContext
    words = materialize(page_words(pages, html), "words")
    host, path = url_parts(F.col(url))
    parsed = pages.select(F.col(key).alias("key"), host.alias("host"), path.alias("path"))
    rule, decision = rule_of(F.col("host"), F.col("path"), rules)
    ruled = parsed.withColumns({"rule": rule, "decision": decision})
    # written once: counts of the model and the verdicts read the same tokens
    found = materialize(url_tokens(ruled, words, ["key", "host", "path", "rule", "decision"], "host", "path"), "url-tokens")
    prior, odds = log_odds(found.where(F.col("decision").isNotNull()), "decision")
    table = shared.broadcast(odds)
    kind = found.drop("buckets").schema.add("block_odds", "double")
    names = found.columns[:-1]

    def start():
        def work(part):
            scores = [prior + float(table.value[b].sum()) if b else prior for b in part.column("buckets").to_pylist()]
            return {**{c: part.column(c) for c in names}, "block_odds": scores}

        return work

    judged = map_slices(found, kind, start)
    model = F.when(F.col("block_odds") > 0, BLOCK).otherwise(ALLOW)
    return judged.select(
        F.col("key").alias(key), "host", "path", "rule", F.coalesce("decision", model).alias("verdict"), "block_odds"
    )
