"""Toxicity by a classifier chain of linear models.

Categories are predicted one after another: the model of a category sees the text's features and the probabilities of
the categories before it. In training those probabilities are out-of-fold: they come from models that did not learn
from the row, as later rows' probabilities will. Features are the distinct hashed byte n-grams within words, so word
parts count in any language and a text of any length is scored whole by what it holds, not by how often.

Training takes a bounded sample of labelled rows; scoring is one pass over all rows without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from rowloom.llm.langid import PIECE_BYTES, gram_buckets, prepare
from rowloom.llm.slices import map_slices

GRAMS = (4, 5)
BUCKET_BITS = 18
# Labelled rows that are learned from, at most about so many.
SAMPLE_ROWS = 8000
FOLDS = 3
ROUNDS = 60
# Features in fewer rows of the sample, or in a larger share of them, say nothing.
RAREST = 3
COMMONEST = 0.3
# A model uses features whose shares among its positive and negative rows differ by so many standard errors.
TELLING = 2.5


def features(text: str | None) -> np.ndarray:
    """Distinct buckets of the whole text's n-grams; a long text is read in overlapping pieces."""
    data = np.frombuffer(prepare(text or ""), np.uint8)
    found = []
    for at in range(0, len(data), PIECE_BYTES):
        piece = data[at : at + PIECE_BYTES + max(GRAMS) - 1]
        found += [np.unique(b) for _, b in gram_buckets(piece, GRAMS, BUCKET_BITS)]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int32)


@dataclass(frozen=True)
class Rows:
    """Feature lists of many rows, end to end."""

    flat: np.ndarray
    sizes: np.ndarray

    @staticmethod
    def of(lists: list[np.ndarray]) -> Rows:
        sizes = np.array([len(x) for x in lists], np.int64)
        return Rows(np.concatenate(lists) if lists else np.zeros(0, np.int32), sizes)

    def sums(self, weights: np.ndarray) -> np.ndarray:
        ends = np.concatenate([[0], np.cumsum(weights[self.flat], dtype=np.float64)])
        stops = np.cumsum(self.sizes)
        return ends[stops] - ends[stops - self.sizes]

    def only(self, useful: np.ndarray) -> Rows:
        """The rows without the features that are not useful."""
        keep = useful[self.flat]
        ends = np.concatenate([[0], np.cumsum(keep)])
        stops = np.cumsum(self.sizes)
        return Rows(self.flat[keep], ends[stops] - ends[stops - self.sizes])

    def take(self, picked: np.ndarray) -> Rows:
        keep = np.repeat(picked, self.sizes)
        return Rows(self.flat[keep], self.sizes[picked])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass(frozen=True)
class Linear:
    """Logistic regression over features and earlier probabilities."""

    weights: np.ndarray
    earlier: np.ndarray
    bias: float

    def predict(self, rows: Rows, earlier: np.ndarray) -> np.ndarray:
        return sigmoid(rows.sums(self.weights) + earlier @ self.earlier + self.bias)


def telling(rows: Rows, labels: np.ndarray) -> np.ndarray:
    """Which features are markedly more or less frequent where the label is 1."""
    n, n_found = max(1, len(labels)), max(1.0, float(labels.sum()))
    seen = np.bincount(rows.flat, minlength=1 << BUCKET_BITS)
    found = np.bincount(rows.flat, weights=np.repeat(labels, rows.sizes), minlength=1 << BUCKET_BITS)
    share = seen / n
    error = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n_found + 1 / max(1.0, n - n_found)))
    return np.abs(found / n_found - (seen - found) / max(1.0, n - n_found)) > TELLING * error


def fit_linear(rows: Rows, earlier: np.ndarray, labels: np.ndarray, rounds: int = ROUNDS) -> Linear:
    """Proximal gradient steps with a rate per weight; an L1 penalty keeps weights of common n-grams at zero."""
    used = telling(rows, labels)
    rows = rows.only(used)
    # Features that are used are numbered from 0 on: the weights of all others stay zero.
    rows = Rows((np.cumsum(used) - 1)[rows.flat], rows.sizes)
    n_used = int(used.sum())
    weights, memory = np.zeros(n_used), np.full(n_used, 1e-8)
    chain, chain_memory = np.zeros(earlier.shape[1]), np.full(earlier.shape[1], 1e-8)
    share = float(np.clip(labels.mean(), 1e-3, 1 - 1e-3)) if len(labels) else 1e-3
    bias = float(np.log(share / (1 - share)))
    for _ in range(rounds if len(labels) else 0):
        error = (sigmoid(rows.sums(weights) + earlier @ chain + bias) - labels) / len(labels)
        slope = np.bincount(rows.flat, weights=np.repeat(error, rows.sizes), minlength=len(weights))
        memory += slope * slope
        rate = 0.3 / np.sqrt(memory)
        moved = weights - rate * slope
        weights = np.sign(moved) * np.maximum(np.abs(moved) - rate * 1e-4, 0)
        back = earlier.T @ error
        chain_memory += back * back
        chain = chain - 0.3 / np.sqrt(chain_memory) * back
        bias -= 2.0 * float(error.sum())
    spread = np.zeros(len(used))
    spread[used] = weights
    return Linear(spread, chain, bias)


@dataclass(frozen=True)
class ToxicityChain:
    """A model per category, in order, and the probability from which a category counts as found."""

    categories: tuple[str, ...]
    models: tuple[Linear, ...]
    limits: tuple[float, ...]

    def predict(self, lists: list[np.ndarray]) -> np.ndarray:
        """A row per text, a column per category."""
        rows, found = Rows.of(lists), np.zeros((len(lists), 0))
        for model in self.models:
            found = np.column_stack([found, model.predict(rows, found)])
        return found


def best_limit(chances: np.ndarray, labels: np.ndarray) -> float:
    """The limit with the best F1, in the middle of its gap."""
    order = np.argsort(-chances, kind="stable")
    hits = np.cumsum(labels[order])
    if not len(hits) or not hits[-1]:
        return 1.1
    precision, recall = hits / np.arange(1, len(hits) + 1), hits / hits[-1]
    quality = 2 * precision * recall / np.maximum(precision + recall, 1e-12)
    at = int(np.argmax(quality))
    below = chances[order[at + 1]] if at + 1 < len(order) else 0.0
    return float((chances[order[at]] + below) / 2)


def train_chain(lists: list[np.ndarray], labels: dict[str, np.ndarray], folds: int = FOLDS) -> ToxicityChain:
    """Fit the categories in the order given; limits are chosen on out-of-fold probabilities."""
    rows = Rows.of(lists)
    seen = np.bincount(rows.flat, minlength=1 << BUCKET_BITS)
    useful = (seen >= RAREST) & (seen <= COMMONEST * max(1, len(lists)))
    rows = rows.only(useful)
    fold = np.arange(len(lists)) % folds
    earlier = np.zeros((len(lists), 0))
    models, limits = [], []
    for label in labels.values():
        outside = np.zeros(len(lists))
        for f in range(folds):
            learned = fold != f
            model = fit_linear(rows.take(learned), earlier[learned], label[learned])
            outside[~learned] = model.predict(rows.take(~learned), earlier[~learned])
        models.append(fit_linear(rows, earlier, label))
        limits.append(best_limit(outside, label))
        earlier = np.column_stack([earlier, outside])
    return ToxicityChain(tuple(labels), tuple(models), tuple(limits))


def fit_chain(
    docs: DataFrame, labels: DataFrame, key: str, text: str, categories: list[str], rows: int = SAMPLE_ROWS, seed: int = 5
) -> ToxicityChain:
    """Learn from about ``rows`` labelled rows at most, drawn by a hash of the key.

    ``labels`` has the key and a 0/1 column per category; rows without text or with a null label teach nothing. Labels
    that contradict each other count as 1, and of several texts of a key one is learned from, so that at most ``rows``
    or so reach the driver, reduced to their features. Other columns of ``docs`` may have any names.
    """
    complete = labels.dropna(subset=[key, *categories])
    share = min(1.0, rows / max(1, complete.count()))
    steps = 1 << 30
    drawn = complete.where(F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(steps)) < F.lit(int(share * steps) + 1))
    # a category that any of a key's labels gives counts
    drawn = drawn.groupBy(F.col(key).alias("__key")).agg(*[F.max(F.col(c).cast("int")).alias(c) for c in categories])
    texts = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("__doc"), F.col(text).alias("__text"))
    met = texts.join(drawn, F.col("__doc") == F.col("__key"))
    # of a key's texts the one with the smallest hash; copies are reduced where they are read
    least = F.min(F.struct(F.xxhash64("__text").alias("hash"), F.col("__text").alias("text")))
    joined = met.groupBy("__key", *categories).agg(least.alias("__text"))
    joined = joined.select("__key", *categories, F.col("__text.text").alias("__text"))
    kind = StructType(joined.schema.fields[:-1]).add("features", ArrayType(IntegerType()))
    names = joined.columns[:-1]

    def start():
        return lambda part: {
            **{c: part.column(c) for c in names},
            "features": [features(x) for x in part.column("__text").to_pylist()],
        }

    found = map_slices(joined, kind, start, "__text").toArrow().sort_by("__key")
    lists = [np.asarray(x.values.to_numpy(), np.int32) for x in found.column("features")]
    return train_chain(lists, {c: found.column(c).to_numpy().astype(np.float64) for c in categories})


def score_toxicity(df: DataFrame, chain: ToxicityChain, text: str, keep: list[str]) -> DataFrame:
    """The columns ``keep``, then ``p_<category>`` for each category and ``flagged`` (the last category is found).

    Null and empty texts have no features: they get the base rates and are never flagged.
    """
    shared = df.sparkSession.sparkContext.broadcast(chain)
    kind = df.select(*keep).schema
    for c in chain.categories:
        kind = kind.add(f"p_{c}", "double")
    kind = kind.add("flagged", "boolean")

    def start():
        model = shared.value

        def work(part):
            lists = [features(x) for x in part.column(len(keep)).to_pylist()]
            chances = model.predict(lists)
            out = {c: part.column(i) for i, c in enumerate(keep)}
            out |= {f"p_{c}": chances[:, i] for i, c in enumerate(model.categories)}
            some = np.array([len(x) > 0 for x in lists], bool)
            return out | {"flagged": some & (chances[:, -1] >= model.limits[-1])}

        return work

    return map_slices(df.select(*keep, F.col(text).alias("__text")), kind, start, "__text")
