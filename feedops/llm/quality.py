"""Quality of whole texts by a generalised additive model with pairwise interactions.

Each text becomes a few measures (letters, symbols, case, repetition of words, word pairs and lines, lengths). Boosting goes round
the features in a cycle: for one feature at a time it fits a tree of ``LEAVES`` leaves to the gradient of the logistic loss, over the
feature's bins, and adds a small step of it to that feature's look-up table. Then pairs of features, those whose coarse grid
explains most of what is left, are boosted in the same cycle with trees that cut both features. A score is a sum of look-ups.

Trained on the driver from at most ``SAMPLE`` labelled rows outside the held fold, taken by a hash of doc_id; texts of all rows are
measured and scored in the tasks. A null or empty text has all measures zero and a score like any other. With no labelled row
every score is 0.5; with labels of one kind it is near that kind. Repeated rows score alike; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedops.llm.common import held_out_key

SAMPLE = 12_000
BINS = 48
PAIR_BINS = 12
PAIRS = 8
LEAVES = 3
FEATURES = (
    "chars", "words", "lines", "word_chars", "line_words", "upper", "digit", "space", "mark", "symbol", "wide", "caps_words", "marked_words",
    "bare_words", "short_words", "long_words", "distinct_words", "top_word", "same_next", "distinct_pairs", "distinct_lines", "sentence_ends", "upper_starts",
)
_KIND = np.zeros(256, np.int64)
_KIND[[*range(65, 91)]] = 1
_KIND[[*range(48, 58)]] = 2
_KIND[[9, 10, 11, 12, 13, 32]] = 3
_KIND[[ord(c) for c in ".,;:!?'\"()-"]] = 4
_KIND[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = 5
_KIND[128:] = 6


def measure(text: bytes | None) -> list[float]:
    """The measures of one text in the order of ``FEATURES``."""
    if not text:
        return [0.0] * len(FEATURES)
    kinds = np.bincount(_KIND[np.frombuffer(text, np.uint8)], minlength=7) / len(text)
    words = text.split()
    lines = [line for line in text.split(b"\n") if line.strip()]
    n, m = max(1, len(words)), max(1, len(lines))
    counts = Counter(words)
    ends = Counter(w[-1] for w in words)
    starts = Counter(w[0] for w in words)
    marks = sum(v for k, v in ends.items() if _KIND[k] == 5 or k == 33)
    distinct = len(counts)
    caps = bare = short = long = 0
    for word, k in counts.items():
        caps += k if word.isupper() and len(word) > 1 else 0
        bare += k if not word.isalpha() and len(word) == 1 else 0
        short += k if len(word) <= 2 else 0
        long += k if len(word) > 14 else 0
    same = sum(a == b for a, b in zip(words, words[1:]))
    pairs = len(set(zip(words, words[1:])))
    return [
        np.log1p(len(text)), np.log1p(len(words)), np.log1p(len(lines)), sum(map(len, words)) / n, len(words) / m,
        kinds[1], kinds[2], kinds[3], kinds[4], kinds[5], kinds[6], caps / n, marks / n, bare / n, short / n, long / n,
        distinct / n, max(counts.values(), default=0) / n, same / n, pairs / max(1, n - 1), len(set(lines)) / m,
        sum(v for k, v in ends.items() if k in b".!?") / n, sum(v for k, v in starts.items() if _KIND[k] == 1) / n,
    ]


def measures(texts: pa.Array) -> np.ndarray:
    rows = [measure(t.as_py()) for t in texts.cast(pa.binary())]
    return np.array(rows, np.float64).reshape(-1, len(FEATURES))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, least: float) -> np.ndarray:
    """Values by bin of a small tree: the cut with the largest gain is made until there are ``leaves`` parts."""
    parts, pull = [(0, len(g))], 1.0
    cg, ch = np.r_[0, np.cumsum(g)], np.r_[0, np.cumsum(h)]

    def best(a: int, b: int) -> tuple[float, int]:
        if b - a < 2:
            return 0.0, a
        k = np.arange(a + 1, b)
        lg, lh, tg, th = cg[k] - cg[a], ch[k] - ch[a], cg[b] - cg[a], ch[b] - ch[a]
        gain = lg**2 / (lh + pull) + (tg - lg) ** 2 / (th - lh + pull) - tg**2 / (th + pull)
        gain[(lh < least) | (th - lh < least)] = 0
        at = int(gain.argmax())
        return float(gain[at]), int(k[at])

    while len(parts) < leaves:
        gain, at, (a, b) = max((*best(*p), p) for p in parts)
        if gain <= 1e-9:
            break
        parts.remove((a, b))
        parts += [(a, at), (at, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + pull)
    return out


def _tree2(g: np.ndarray, h: np.ndarray, least: float) -> tuple[np.ndarray, float]:
    """Values on a grid of a tree that cuts one feature and then, on either side, the other; and its gain."""
    best_gain, best = 0.0, np.zeros_like(g)
    for turned in (False, True):
        gg, hh = (g.T, h.T) if turned else (g, h)
        for at in range(1, gg.shape[0]):
            out, gain = np.empty_like(gg), 0.0
            for side in (slice(0, at), slice(at, None)):
                sg, sh = gg[side].sum(0), hh[side].sum(0)
                values = _tree(sg, sh, 2, least)
                gain += float((values * sg).sum() - 0.5 * (values**2 * sh).sum())
                out[side] = values
            if gain > best_gain:
                best_gain, best = gain, out.T if turned else out
    return best, best_gain


class Model:
    """Bin edges, tables by feature, and tables by pair."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 120, pair_rounds: int = 30, rate: float = 0.15, least: float = 2.0):
        self.edges = [np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1])) for column in x.T]
        self.coarse = [np.unique(np.quantile(column, np.linspace(0, 1, PAIR_BINS + 1)[1:-1])) for column in x.T]
        share = (y.sum() + 1) / (len(y) + 2)
        self.base = float(np.log(share / (1 - share)))
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        self.pairs: dict[tuple[int, int], np.ndarray] = {}
        fine, rough = self.bins(x)
        total = np.full(len(y), self.base)

        def slope() -> tuple[np.ndarray, np.ndarray]:
            p = 1 / (1 + np.exp(-total))
            return y - p, p * (1 - p)

        for _ in range(rounds):
            for k, table in enumerate(self.tables):
                g, h = slope()
                step = rate * _tree(np.bincount(fine[k], g, len(table)), np.bincount(fine[k], h, len(table)), LEAVES, least)
                table += step
                total += step[fine[k]]

        def grid(i: int, j: int, weights: np.ndarray) -> np.ndarray:
            shape = len(self.coarse[i]) + 1, len(self.coarse[j]) + 1
            return np.bincount(rough[i] * shape[1] + rough[j], weights, shape[0] * shape[1]).reshape(shape)

        g, h = slope()
        ranked = sorted(combinations(range(x.shape[1]), 2), key=lambda p: -_tree2(grid(*p, g), grid(*p, h), least)[1])
        self.pairs = {p: np.zeros((len(self.coarse[p[0]]) + 1, len(self.coarse[p[1]]) + 1)) for p in ranked[:PAIRS]}
        for _ in range(pair_rounds):
            for (i, j), table in self.pairs.items():
                g, h = slope()
                step = rate * _tree2(grid(i, j, g), grid(i, j, h), least)[0]
                table += step
                total += step[rough[i], rough[j]]
        for table, own in zip(self.tables, fine):
            shift = table[own].mean()
            table -= shift
            self.base += float(shift)

    def bins(self, x: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        return tuple([np.searchsorted(e, column, "right") for e, column in zip(edges, x.T)] for edges in (self.edges, self.coarse))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1: look-ups and additions."""
        fine, rough = self.bins(x)
        total = np.full(len(x), self.base)
        for table, own in zip(self.tables, fine):
            total += table[own]
        for (i, j), table in self.pairs.items():
            total += table[rough[i], rough[j]]
        return 1 / (1 + np.exp(-total))


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, sample: int = SAMPLE) -> Model | None:
    """Fits a model on at most ``sample`` rows of ``labels`` (doc_id, quality 0/1) that are not of the held fold."""
    known = labels.filter(F.col("quality").isNotNull() & (F.pmod(held_out_key("doc_id"), F.lit(folds)) != held)).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")
    )
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = measures(batch.column("text"))
            yield pa.record_batch([batch.column("doc_id"), batch.column("quality"), pa.array(list(found), pa.list_(pa.float64()))], names=["doc_id", "quality", "x"])

    rows = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text")
    got = rows.mapInArrow(run, "doc_id long, quality int, x array<double>").orderBy("doc_id", "quality").toArrow()
    if not got.num_rows:
        return None
    return Model(np.array(got.column("x").to_pylist()), got.column("quality").to_numpy().astype(np.float64))


def score(docs: DataFrame, model: Model | None, folds: int = 5, held: int = 0, limit: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of ``docs`` (doc_id, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model.score(measures(batch.column("text"))) if model else np.full(batch.num_rows, 0.5)
            yield pa.record_batch([batch.column("doc_id"), pa.array(np.round(found, 6))], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double").select(
        "doc_id", F.coalesce(F.pmod(held_out_key("doc_id"), F.lit(folds)) == held, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= limit).cast("int").alias("predicted"),
    )
