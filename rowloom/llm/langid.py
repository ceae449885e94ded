"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text becomes the mean of the embeddings of its byte 3- and 4-grams inside words (a word's edge counts as a
byte), found by hashing; a linear layer with softmax turns the mean into probabilities. Both layers are trained
together by stochastic gradient descent in numpy, on a bounded sample of labelled rows. On a part of the sample that
training does not see, a temperature and two limits for rejection are fitted: one for the probability, one for how
familiar a text is. A softmax knows only the learned languages and may be sure about any other; so the table also holds
how common each bucket's n-grams are in the sample, and a text whose n-grams are much rarer than usual is rejected.

After training, embeddings and linear layer are multiplied into one table with a row per bucket, so a text costs
one table look-up per n-gram. Prediction reads every text whole, in one pass without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm.slices import map_slices

UNDETERMINED = "und"
BUCKET_BITS = 15
BUCKETS = 1 << BUCKET_BITS
DIMENSIONS = 16
# Of the labelled rows, at most about so many are learned from, with an excerpt of so many characters each.
SAMPLE_ROWS = 4096
SAMPLE_CHARS = 2000
# Training takes at least so many steps.
STEPS = 800
# Beyond so many n-grams a longer text is not known any better.
MOST_GRAMS = 64
# Held-out excerpts are also judged by so many characters from their start.
CUTS = (20, 60, 200)
# A text longer than this is summed up in pieces.
PIECE_BYTES = 1 << 20

# Letters and everything beyond ASCII stay, anything else becomes a blank.
_KEEP = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
_MIX = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35), np.uint32(0x27D4EB2F))


def prepare(text: str) -> bytes:
    """Lower case, other signs blanked, one blank before and after."""
    return b" " + text.lower().encode("utf-8", "replace").translate(_KEEP) + b" "


def gram_buckets(
    data: np.ndarray, sizes: tuple[int, ...] = (3, 4), bits: int = BUCKET_BITS
) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each size, (start positions, buckets) of the n-grams that lie within one word, edges included."""
    found, wide, blank = [], data.astype(np.uint32), data == 32
    for n in sizes:
        count = len(data) - n + 1
        if count <= 0:
            continue
        inside = ~blank[1 : 1 + count]
        code = wide[:count] * _MIX[0]
        for k in range(1, n):
            code = code ^ (wide[k : k + count] * _MIX[k % 4])
            code = (code << np.uint32(7)) | (code >> np.uint32(25))
            if 1 < k < n - 1:
                inside &= ~blank[k : k + count]
        at = np.flatnonzero(inside)
        found.append((at, ((code[at] * _MIX[0]) >> np.uint32(32 - bits)).astype(np.int32)))
    return found


def text_sums(texts: list[bytes], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the table rows of each text's n-grams, and their number."""
    sums, counts = np.zeros((len(texts), table.shape[1])), np.zeros(len(texts), dtype=np.int64)
    joined, owner, size = [], [], 0

    def flush():
        if not joined:
            return
        starts = np.cumsum([0] + [len(x) for x in joined[:-1]])
        owners = np.array(owner)
        for at, bucket in gram_buckets(np.frombuffer(b"".join(joined), dtype=np.uint8)):
            # An n-gram with a blank inside is left out, so none spans two texts.
            edges = np.searchsorted(at, starts)
            n = np.diff(np.append(edges, len(at)))
            some = n > 0
            if some.any():
                rows = np.add.reduceat(table[bucket], edges[some], axis=0, dtype=np.float64)
                np.add.at(sums, owners[some], rows)
                np.add.at(counts, owners[some], n[some])
        joined.clear()
        owner.clear()

    for i, text in enumerate(texts):
        for at in range(0, len(text), PIECE_BYTES):
            # Pieces of a very long text overlap by what an n-gram needs; each n-gram starts in one of them.
            piece = text[at : at + PIECE_BYTES + 3] if at + PIECE_BYTES < len(text) else text[at:]
            if at + PIECE_BYTES < len(text):
                flush()
                for k, (start, bucket) in enumerate(gram_buckets(np.frombuffer(piece, dtype=np.uint8))):
                    bucket = bucket[start < PIECE_BYTES]
                    sums[i] += table[bucket].sum(axis=0, dtype=np.float64)
                    counts[i] += len(bucket)
                continue
            joined.append(piece)
            owner.append(i)
            size += len(piece)
            if size >= PIECE_BYTES:
                flush()
                size = 0
    flush()
    return sums, counts


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass(frozen=True)
class LanguageModel:
    """``table`` has a row per bucket and a column per language, then one for how common the bucket is (log, standardized).

    A score below ``threshold`` is a rejection, and so is a familiarity below ``strangest``.
    """

    languages: tuple[str, ...]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float
    strangest: float = -np.inf

    def judge(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        """Language and calibrated probability of each text, and whether it is accepted."""
        names, scores, kept = [UNDETERMINED] * len(texts), [0.0] * len(texts), [False] * len(texts)
        asked = [i for i, x in enumerate(texts) if x is not None and any(map(str.isalpha, x))]
        if asked and self.languages:
            sums, counts = text_sums([prepare(texts[i]) for i in asked], self.table)
            logits = sums[:, :-1] / np.maximum(counts, 1)[:, None] + self.bias
            chance = softmax(logits / self.temperature)
            common = familiarity(sums[:, -1], counts)
            for i, k, p, f in zip(asked, chance.argmax(axis=1), chance.max(axis=1), common, strict=True):
                names[i], scores[i] = self.languages[k], float(p)
                kept[i] = bool(p >= self.threshold and f >= self.strangest)
        return names, scores, kept

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and calibrated probability of each text."""
        names, scores, _ = self.judge(texts)
        return names, scores


def familiarity(sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """How far the mean commonness of a text's n-grams is from the usual one, in standard errors; 0 without n-grams.

    Errors shrink with the number of n-grams up to a point: texts of one language differ among themselves.
    """
    return sums / np.maximum(counts, 1) * np.sqrt(np.minimum(counts, MOST_GRAMS))


def labelled_sample(df: DataFrame, key: str, text: str, label: str, rows: int, seed: int) -> list[tuple[str, str]]:
    """(label, excerpt) of about ``rows`` labelled rows at most, spread evenly over the labels.

    Rows are drawn by a hash of the key, the excerpt starts at a hashed place of the text.
    """
    usable = df.where(F.col(text).isNotNull() & F.col(label).isNotNull()).select(key, text, label)
    sizes = usable.groupBy(label).count().orderBy(F.desc("count"), label).limit(rows).collect()
    if not sizes:
        return []
    quota = max(1, rows // len(sizes))
    steps = 1 << 30
    share = F.create_map(
        *(F.lit(x) for r in sizes for x in (r[label], min(steps, -(-quota * steps // r["count"]))))
    )
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col(key), F.substring(text, 1, 64)), F.lit(steps))
    begin = F.pmod(F.xxhash64(F.lit(seed + 1), F.col(key)), F.greatest(F.lit(1), F.length(text) - SAMPLE_CHARS))
    drawn = usable.where(draw < F.element_at(share, F.col(label))).select(
        label, F.substring(F.col(text), (begin + 1).cast("int"), F.lit(SAMPLE_CHARS)).alias("excerpt"), draw.alias("draw")
    )
    found = sorted((r["draw"], r[label], r["excerpt"]) for r in drawn.collect())
    return [(name, excerpt) for _, name, excerpt in found]


def train(sample: list[tuple[str, str]], seed: int = 7, epochs: int = 6, rate: float = 8.0, batch: int = 32) -> LanguageModel:
    """Stochastic gradient descent over both layers; every fifth example only calibrates."""
    languages = tuple(sorted({name for name, _ in sample}))
    if not languages:
        return LanguageModel((), np.zeros((BUCKETS, 1), np.float32), np.zeros(0), 1.0, 0.0)
    place = {name: k for k, name in enumerate(languages)}
    grams = []
    for _, excerpt in sample:
        parts = gram_buckets(np.frombuffer(prepare(excerpt), dtype=np.uint8))
        grams.append(np.concatenate([b for _, b in parts]) if parts else np.zeros(0, np.int32))
    labels = np.array([place[name] for name, _ in sample])
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    linear = rng.normal(0, 0.1, (DIMENSIONS, len(languages))).astype(np.float32)
    bias = np.zeros(len(languages), np.float32)

    def means(picked: np.ndarray) -> np.ndarray:
        x = np.stack([np.bincount(grams[i], minlength=BUCKETS) for i in picked]).astype(np.float32)
        return x / np.maximum(1, x.sum(axis=1, keepdims=True))

    held = np.arange(len(sample)) % 5 == 4
    learned = np.flatnonzero(~held)
    # A small sample is gone over more often.
    epochs = max(epochs, -(-STEPS // max(1, -(-len(learned) // batch))))
    steps = max(1, epochs * -(-len(learned) // batch))
    step = 0
    for _ in range(epochs):
        order = rng.permutation(learned)
        for at in range(0, len(order), batch):
            picked = order[at : at + batch]
            pace = np.float32(rate * (1 - step / steps) / len(picked))
            x = means(picked)
            hidden = x @ embed
            error = softmax(hidden @ linear + bias)
            error[np.arange(len(picked)), labels[picked]] -= 1
            back = error @ linear.T
            linear -= pace * 0.1 * (hidden.T @ error)
            bias -= pace * 0.01 * error.sum(axis=0)
            embed -= pace * (x.T @ back) * 10
            step += 1
    table = (embed @ linear).astype(np.float32)
    table = np.column_stack([table, commonness([grams[i] for i in learned])]).astype(np.float32)
    # what training did not see, whole and in short cuts, whose scores are those of short texts
    checked = np.repeat(np.flatnonzero(held) if held.any() else learned, len(CUTS) + 1)
    cuts = [prepare(sample[i][1][:cut]) for i, cut in zip(checked, (*CUTS, None) * len(checked), strict=False)]
    sums, counts = text_sums(cuts, table)
    some = counts > 0
    logits = sums[some, :-1] / counts[some, None] + bias
    temperature, threshold = calibrate(logits, labels[checked[some]])
    return LanguageModel(
        languages, table, bias, temperature, threshold, lower_limit(familiarity(sums[some, -1], counts[some]))
    )


def commonness(grams: list[np.ndarray]) -> np.ndarray:
    """The logarithm of how often each bucket is met, with mean 0 and deviation 1 over what is met."""
    seen = np.bincount(np.concatenate(grams), minlength=BUCKETS) if grams else np.zeros(BUCKETS, np.int64)
    logs = np.log(seen + 0.5)
    total = max(1, seen.sum())
    mean = (seen * logs).sum() / total
    return (logs - mean) / max(1e-6, np.sqrt((seen * (logs - mean) ** 2).sum() / total))


def lower_limit(values: np.ndarray, tail: float = 0.001, edge: float = 0.05) -> float:
    """As far below the ``tail`` quantile as that is below the ``edge`` quantile: few usual values lie beyond."""
    if not len(values):
        return -np.inf
    low, near = np.quantile(values, [tail, edge])
    return float(low - (near - low))


def calibrate(logits: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """The temperature with the highest likelihood, and the score that next to no right prediction stays below.

    The limit is found on the scale of log odds.
    """
    rows = np.arange(len(labels))
    grid = np.geomspace(0.05, 20, 60)
    losses = [-np.log(np.maximum(softmax(logits / t)[rows, labels], 1e-12)).mean() for t in grid]
    best = float(grid[int(np.argmin(losses))])
    chance = softmax(logits / best)
    right = np.clip(chance[rows, labels][chance.argmax(axis=1) == labels].astype(np.float64), 1e-9, 1 - 1e-9)
    return best, float(1 / (1 + np.exp(-lower_limit(np.log(right / (1 - right))))))


def fit_languages(
    df: DataFrame, key: str, text: str, label: str, rows: int = SAMPLE_ROWS, seed: int = 7
) -> LanguageModel:
    """Learn from about ``rows`` of the labelled rows at most. Rows without a text or a label teach nothing."""
    return train(labelled_sample(df, key, text, label, rows, seed), seed)


def predict_languages(df: DataFrame, model: LanguageModel, text: str, keep: list[str]) -> DataFrame:
    """The columns ``keep``, then ``lang_pred`` and ``score``, for every row of ``df``.

    A null text and one without a letter give ``und`` with score 0, as does a model that learned nothing.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = df.select(*keep).schema.add("lang_pred", "string").add("score", "double")

    def start():
        def work(part):
            names, scores = shared.value.predict(part.column(part.num_columns - 1).to_pylist())
            return {**{c: part.column(i) for i, c in enumerate(keep)}, "lang_pred": names, "score": scores}

        return work

    return map_slices(df.select(*keep, F.col(text).alias("__text")), kind, start, "__text")


def accepted(df: DataFrame, model: LanguageModel, text: str) -> DataFrame:
    """The rows whose language is predicted with at least the model's threshold and that look familiar; columns unchanged."""
    import pyarrow as pa

    shared = df.sparkSession.sparkContext.broadcast(model)
    at = df.columns.index(text)

    def start():
        def work(part):
            return part.filter(pa.array(shared.value.judge(part.column(at).to_pylist())[2], pa.bool_()))

        return work

    return map_slices(df, df.schema, start, text)
