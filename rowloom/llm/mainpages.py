"""Main text of web pages by a linear-chain conditional random field over the leaf blocks of their DOM.

A block (a run of text between the borders of block elements) is either main text or not. Features are the elements that
enclose it, their class names, ids and roles, the nearest landmark, and facts about its text; transitions depend on
whether two neighbours share a container. The field is trained on labelled pages by its likelihood (numpy), and a page is
decoded by Viterbi. Nothing of a page is left out: every block gets its label from the whole page.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rowloom.llm.dom import Block, Marks, leaf_blocks
from rowloom.llm.labelled_pages import labelled_pages
from rowloom.llm.slices import map_slices

# Labelled pages that the field is trained on, and their seed.
PAGES, SEED = 1500, 12
ROUNDS, RATE, DECAY = 150, 0.1, 2e-6
# Words that name what surrounds articles, counted in texts of a few words.
SIGNALS = frozenset(
    "home login menu search share tweet follow print subscribe newsletter signup cookie cookies consent privacy terms imprint contact"
    " copyright reserved powered advertisement advert sponsored promoted related popular tags archive categories previous next top"
    " comment comments reply replies password submit send anzeige werbung kommentare startseite datenschutz impressum publicité"
    " commentaires accueil confidentialité publicidad comentarios inicio privacidad".split()
)
SHORT_WORDS = 10
# A mark counts only if so many blocks of the labelled pages have it.
LEAST_BLOCKS = 3


_DIGITS = re.compile("[0-9]+")


def _text_marks(block: Block) -> list[str]:
    words = block.text.split()
    size = len(words)
    steps = sum(size >= s for s in (2, 3, 5, 8, 12, 20, 40))
    linked = block.linked / size
    marks = [f"size:{steps}", f"links:{sum(linked > s for s in (0, 0.2, 0.5, 0.9))}", f"commas:{min(3, block.text.count(','))}"]
    last = block.text[-1]
    marks.append("end:sentence" if last in ".!?…" else "end:letter" if last.isalpha() else "end:other")
    if "©" in block.text:
        marks.append("copyright")
    if any(c in block.text for c in "|·»›•"):
        marks.append("separator")
    if sum(map(len, _DIGITS.findall(block.text))) * 4 > len(block.text):
        marks.append("digits")
    if size <= SHORT_WORDS:
        marks.append(f"signals:{min(2, sum(w.lower().strip('.,:;!?') in SIGNALS for w in words))}")
    return marks


@lru_cache(maxsize=4096)
def _bits(number: int) -> list[int]:
    return [i for i, c in enumerate(reversed(bin(number)[2:])) if c == "1"]


def page_features(blocks: list[Block], marks: Marks) -> list[list[int]]:
    """Numbers of each block's marks: of what encloses it, of its text, and of where the page has its articles."""
    inside = {name: marks.bit(f"in:{name}") for name in ("article", "main")}
    has = {name: any(b.around & bit for b in blocks) for name, bit in inside.items()}
    heading = next((i for i, b in enumerate(blocks) if b.tag == "h1"), -1)
    found = []
    for i, block in enumerate(blocks):
        own = [f"tag:{block.tag}", f"parent:{block.parent}", f"near:{block.landmark}", f"tag:{block.tag}:{block.landmark}"]
        own += [f"outside:{name}" for name, bit in inside.items() if has[name] and not block.around & bit]
        own.append("heading:" + ("none" if heading < 0 else "before" if i < heading else "from"))
        places = (marks.place(mark) for mark in {*own, *_text_marks(block)})
        found.append([*_bits(block.around), *(p for p in places if p >= 0)])
    return found


@dataclass
class Field:
    """Weights of the marks, of transitions (by whether the container is shared), and of first and last labels."""

    marks: Marks
    weights: np.ndarray
    bias: float
    steps: np.ndarray
    first: np.ndarray
    last: np.ndarray

    def scores(self, features: list[list[int]]) -> list[float]:
        """How much more each block looks like main text by itself."""
        sizes = [len(f) for f in features]
        flat = np.fromiter((i for f in features for i in f), np.int64, sum(sizes))
        starts = np.cumsum([0, *sizes[:-1]])
        # every block has a mark of its size
        return (np.add.reduceat(self.weights[flat], starts) + self.bias).tolist()

    def decode(self, blocks: list[Block]) -> list[bool]:
        """The likeliest labels of a page's blocks, by Viterbi."""
        if not blocks:
            return []
        own = self.scores(page_features(blocks, self.marks))
        steps, last = self.steps.tolist(), self.last.tolist()
        no, yes = self.first[0], self.first[1] + own[0]
        back = []
        for i in range(1, len(blocks)):
            (nn, ny), (yn, yy) = steps[blocks[i].container == blocks[i - 1].container]
            from_no, from_yes = (no + nn >= yes + yn), (no + ny >= yes + yy)
            back.append((from_no, from_yes))
            no, yes = max(no + nn, yes + yn), max(no + ny, yes + yy) + own[i]
        label = yes + last[1] > no + last[0]
        labels = [label]
        for from_no, from_yes in reversed(back):
            label = not (from_yes if label else from_no)
            labels.append(label)
        return labels[::-1]


def gradients(own, same, mask, truth, steps, first, last):
    """Log-likelihood of padded pages and its gradients by forward and backward sums.

    ``own`` is pages x blocks of scores of main text, ``same`` whether a block shares the container of the one before,
    ``truth`` its label.
    """
    pages, size = own.shape
    unary = np.stack([np.zeros_like(own), own], axis=2)
    move = steps[same.astype(int)]  # pages x blocks x before x after
    forward, backward = np.zeros((pages, size, 2)), np.zeros((pages, size, 2))
    forward[:, 0] = first + unary[:, 0]
    for t in range(1, size):
        reached = np.logaddexp.reduce(forward[:, t - 1, :, None] + move[:, t], axis=1) + unary[:, t]
        forward[:, t] = np.where(mask[:, t, None], reached, forward[:, t - 1])
    ends = mask.sum(axis=1) - 1
    rows = np.arange(pages)
    total = np.logaddexp.reduce(forward[rows, ends] + last, axis=1)
    backward[:, size - 1] = last
    for t in range(size - 2, -1, -1):
        reached = np.logaddexp.reduce(move[:, t + 1] + (unary[:, t + 1] + backward[:, t + 1])[:, None, :], axis=2)
        backward[:, t] = np.where(mask[:, t + 1, None], reached, last)
    chance = np.exp(forward + backward - total[:, None, None]) * mask[:, :, None]
    both = forward[:, :-1, :, None] + move[:, 1:] + (unary[:, 1:] + backward[:, 1:])[:, :, None, :]
    both = np.exp(np.minimum(both - total[:, None, None, None], 0)) * mask[:, 1:, None, None]

    given = np.stack([~truth, truth], axis=2) & mask[:, :, None]
    d_own = (given - chance)[:, :, 1]
    seen = (given[:, :-1, :, None] & given[:, 1:, None, :]) - both
    d_steps = np.stack([seen[~same[:, 1:]].sum(axis=0), seen[same[:, 1:]].sum(axis=0)])
    d_first = (given[:, 0] - chance[:, 0]).sum(axis=0)
    d_last = (given[rows, ends] - chance[rows, ends]).sum(axis=0)
    path = np.where(truth, own, 0) * mask
    pairs = move[rows[:, None], np.arange(1, size), truth[:, :-1].astype(int), truth[:, 1:].astype(int)] * mask[:, 1:]
    likelihood = path.sum() + pairs.sum() + first[truth[:, 0].astype(int)].sum() + last[truth[rows, ends].astype(int)].sum() - total.sum()
    return likelihood, d_own, d_steps, d_first, d_last


def _labels(blocks: list[Block], main: list[str]) -> list[bool]:
    """Which blocks are the main texts, which come in order."""
    left, labels = list(reversed(main)), []
    for block in blocks:
        labels.append(bool(left) and block.text == " ".join(left[-1].split()))
        if labels[-1]:
            left.pop()
    return labels


def train(pages: list[tuple[str, list[str]]], rounds: int = ROUNDS) -> Field:
    """A field from labelled pages: HTML and the main blocks' texts in order. Pages without blocks teach nothing."""
    marks = Marks()
    given = [(leaf_blocks(html, marks), main) for html, main in pages]
    given = [(blocks, _labels(blocks, main)) for blocks, main in given if blocks]
    features = [page_features(blocks, marks) for blocks, _ in given]
    marks.learning = False
    size = max(len(blocks) for blocks, _ in given)
    mask, truth, same = (np.zeros((len(given), size), bool) for _ in range(3))
    for i, (blocks, labels) in enumerate(given):
        mask[i, : len(blocks)] = True
        truth[i, : len(blocks)] = labels
        same[i, 1 : len(blocks)] = [a.container == b.container for a, b in zip(blocks, blocks[1:], strict=False)]
    flat = np.array([i for page in features for f in page for i in f])
    sizes = np.array([len(f) for page in features for f in page])
    starts, block = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes)), sizes)
    rare = np.bincount(flat, minlength=len(marks.number)) < LEAST_BLOCKS

    values = [np.zeros(len(marks.number)), np.zeros(1), np.zeros((2, 2, 2)), np.zeros(2), np.zeros(2)]
    mean, square = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    for turn in range(1, rounds + 1):
        own = np.zeros(mask.shape)
        own[mask] = np.add.reduceat(values[0][flat], starts) + values[1]
        _, d_own, *rest = gradients(own, same, mask, truth, *values[2:])
        each = d_own[mask]
        slopes = [np.bincount(flat, each[block], len(marks.number)), each.sum(keepdims=True), *rest]
        for k, slope in enumerate(slopes):
            slope = slope / len(sizes) - DECAY * values[k]
            if k == 0:
                slope[rare] = 0
            mean[k] = 0.9 * mean[k] + 0.1 * slope
            square[k] = 0.99 * square[k] + 0.01 * slope**2
            step = (mean[k] / (1 - 0.9**turn)) / (np.sqrt(square[k] / (1 - 0.99**turn)) + 1e-8)
            values[k] = values[k] + RATE * (1 - turn / (rounds + 1)) * step
    # marks without a weight are forgotten
    kept = Marks()
    kept.number = {mark: i for i, mark in enumerate(m for m, n in marks.number.items() if not rare[n])}
    kept.learning = False
    return Field(kept, values[0][~rare], float(values[1][0]), *values[2:])


@lru_cache(maxsize=1)
def default_field() -> Field:
    """The field trained on ``PAGES`` made pages."""
    return train(labelled_pages(PAGES, SEED))


def main_text(html: str | None, field: Field) -> str:
    """Main blocks joined by empty lines; empty for a page without any."""
    blocks = leaf_blocks(html, field.marks)
    return "\n\n".join(b.text for b, kept in zip(blocks, field.decode(blocks), strict=True) if kept)


def extract_main_text(df: DataFrame, html: str, keep: list[str], field: Field | None = None) -> DataFrame:
    """``keep`` and the main ``text`` of every row's whole HTML, with its code points ``n_chars``.

    Null and empty HTML give an empty text. Rows are independent: repeated rows give repeated results.
    """
    model = field or default_field()
    kind = StructType(df.select(*keep).schema.fields).add("text", "string").add("n_chars", "long")

    def start():
        def work(part):
            texts = [main_text(x, model) for x in part.column("__html").to_pylist()]
            return {**{k: part.column(k) for k in keep}, "text": texts, "n_chars": [len(t) for t in texts]}

        return work

    return map_slices(df.select(*keep, F.col(html).cast("string").alias("__html")), kind, start, "__html")


def page_blocks(df: DataFrame, html: str, keep: list[str], field: Field | None = None) -> DataFrame:
    """``keep`` and an array ``blocks`` of (text, tag, main): all leaf blocks of every page, in order, with their labels."""
    model = field or default_field()
    more = StructType.fromDDL("blocks array<struct<text:string,tag:string,main:boolean>>")
    kind = StructType([*df.select(*keep).schema.fields, *more.fields])

    def start():
        def labelled(page):
            blocks = leaf_blocks(page, model.marks)
            return [{"text": b.text, "tag": b.tag, "main": m} for b, m in zip(blocks, model.decode(blocks), strict=True)]

        def work(part):
            return {**{k: part.column(k) for k in keep}, "blocks": [labelled(x) for x in part.column("__html").to_pylist()]}

        return work

    return map_slices(df.select(*keep, F.col(html).cast("string").alias("__html")), kind, start, "__html")
