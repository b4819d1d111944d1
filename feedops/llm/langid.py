"""Language of whole texts by a small bidirectional gated recurrent network over bytes, in numpy.

Each direction has ``hidden`` units with one gate: ``g = clip(a(x) + h A, 0, 1)``, ``c = tanh(b(x) + (g h) B)``,
``h' = h + g (c - h)``, where a(x) and b(x) are table look-ups by byte. A softmax over both directions' states labels every
position; a document's probabilities are the mean over its positions. Texts are read whole, in windows of ``WINDOW`` bytes in
which the state starts anew, many windows side by side. Training is backpropagation through time with Adam, on the driver,
over a sample of labelled rows bounded by the parameters ``per_label`` and ``chars``; everything else reads all rows.

The language is never decided by anything but the text. A null text or one without letters is ``und`` with score 0; so is
every text if there is no labelled row to learn from. Repeated rows get the same answer, extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedops.llm.common import held_out_key, keep

WINDOW = 96
PAD = 256
HIDDEN = 8
#: Documents per language and characters of each that training may see.
PER_LABEL = 400
CHARS = 384
SPARE = 4
UNKNOWN = "und"


class Network:
    """Weights: gate and candidate tables by direction and byte, recurrent matrices, and the label layer."""

    def __init__(self, labels: list[str], hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.w = {
            "ga": (rng.normal(0, 0.1, (2, 256, hidden)) + 0.5).astype(np.float32),
            "ca": rng.normal(0, 0.4, (2, 256, hidden)).astype(np.float32),
            "gh": rng.normal(0, 0.1, (2, hidden, hidden)).astype(np.float32),
            "ch": rng.normal(0, 0.5 / np.sqrt(hidden), (2, hidden, hidden)).astype(np.float32),
            "out": rng.normal(0, 0.3, (2, hidden, len(labels))).astype(np.float32),
            "bias": np.zeros(len(labels), np.float32),
        }

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Look-up tables with both directions below each other and a closing row of padding, whose gate is shut."""
        hidden = self.w["ga"].shape[2]
        shut = np.full((2, 1, hidden), -1e6, np.float32)
        gate = np.concatenate([self.w["ga"], shut], 1).reshape(-1, hidden)
        cell = np.concatenate([self.w["ca"], np.zeros((2, 1, hidden), np.float32)], 1).reshape(-1, hidden)
        return gate, cell

    def states(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(time, window, unit) of either direction for windows (n, time) of bytes; the second is already turned back."""
        n, steps = windows.shape
        gate, cell = self.tables()
        at = np.stack([windows.T, windows.T[::-1] + (PAD + 1)], 1).astype(np.intp)
        hidden = gate.shape[1]
        ahead, back = (np.empty((steps, n, hidden), np.float32) for _ in range(2))
        h = np.zeros((2, n, hidden), np.float32)
        g, c, x = (np.empty_like(h) for _ in range(3))
        for t in range(steps):
            np.matmul(h, self.w["gh"], out=g)
            g += np.take(gate, at[t], 0, out=x, mode="clip")
            np.maximum(g, 0, out=g)
            np.minimum(g, 1, out=g)
            np.matmul(np.multiply(g, h, out=x), self.w["ch"], out=c)
            c += np.take(cell, at[t], 0, out=x, mode="clip")
            np.tanh(c, out=c)
            c -= h
            c *= g
            h += c
            ahead[t] = h[0]
            back[steps - 1 - t] = h[1]
        return ahead, back

    def positions(self, windows: np.ndarray) -> np.ndarray:
        """(label, time, window): the probabilities of every position."""
        ahead, back = self.states(windows)
        hidden = ahead.shape[2]
        p = self.w["out"][0].T @ ahead.reshape(-1, hidden).T
        p += self.w["out"][1].T @ back.reshape(-1, hidden).T
        p += self.w["bias"][:, None]
        p -= p.max(axis=0)
        np.exp(p, out=p)
        p /= p.sum(axis=0)
        return p.reshape(len(p), *ahead.shape[:2])

    def gradients(self, windows: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy over the real positions and its gradients, backwards through time."""
        n, steps = windows.shape
        gate, cell = self.tables()
        at = np.stack([windows.T, windows.T[::-1] + (PAD + 1)], 1).astype(np.intp)
        hidden = gate.shape[1]
        hs = np.zeros((steps + 1, 2, n, hidden), np.float32)
        raw, gs, cs = (np.empty((steps, 2, n, hidden), np.float32) for _ in range(3))
        for t in range(steps):
            raw[t] = gate[at[t]] + hs[t] @ self.w["gh"]
            gs[t] = np.clip(raw[t], 0, 1)
            cs[t] = np.tanh(cell[at[t]] + (gs[t] * hs[t]) @ self.w["ch"])
            hs[t + 1] = hs[t] + gs[t] * (cs[t] - hs[t])
        ahead, back = hs[1:, 0], hs[1:, 1][::-1]
        logits = ahead @ self.w["out"][0] + back @ self.w["out"][1] + self.w["bias"]
        logits -= logits.max(2, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(2, keepdims=True)
        real = (windows.T != PAD).astype(np.float32)
        total = max(1.0, float(real.sum()))
        loss = -float((np.log(p[:, np.arange(n), label] + 1e-9) * real).sum()) / total
        p[:, np.arange(n), label] -= 1
        p *= real[:, :, None] / total
        grad = {k: np.zeros_like(v) for k, v in self.w.items()}
        grad["bias"] = p.sum((0, 1))
        grad["out"] = np.stack([np.einsum("tnh,tnk->hk", ahead, p), np.einsum("tnh,tnk->hk", back, p)])
        into = np.stack([p @ self.w["out"][0].T, (p @ self.w["out"][1].T)[::-1]], 1)
        table_g, table_c = (np.empty((steps, 2, n, hidden), np.float32) for _ in range(2))
        dh = np.zeros((2, n, hidden), np.float32)
        turned = {k: self.w[k].transpose(0, 2, 1) for k in ("gh", "ch")}
        for t in range(steps - 1, -1, -1):
            dh = dh + into[t]
            h, g, c = hs[t], gs[t], cs[t]
            dc = dh * g * (1 - c * c)
            dr = dc @ turned["ch"]
            dg = (dh * (c - h) + dr * h) * ((raw[t] > 0) & (raw[t] < 1))
            grad["ch"] += (g * h).transpose(0, 2, 1) @ dc
            grad["gh"] += h.transpose(0, 2, 1) @ dg
            table_c[t], table_g[t] = dc, dg
            dh = dh * (1 - g) + dr * g + dg @ turned["gh"]
        byte = at.reshape(-1)
        for name, table in (("ga", table_g.reshape(-1, hidden)), ("ca", table_c.reshape(-1, hidden))):
            sums = np.stack([np.bincount(byte, table[:, k], 2 * (PAD + 1)) for k in range(hidden)], 1)
            grad[name] = sums.astype(np.float32).reshape(2, PAD + 1, hidden)[:, :PAD]
        return loss, grad

    def fit(self, windows: np.ndarray, label: np.ndarray, steps: int = 260, size: int = 160, rate: float = 0.02, seed: int = 11) -> float:
        """Adam over random sets of windows, every language equally often."""
        rng = np.random.default_rng(seed)
        share = 1 / np.bincount(label, minlength=len(self.labels))[label]
        share /= share.sum()
        mean = {k: np.zeros_like(v) for k, v in self.w.items()}
        square = {k: np.zeros_like(v) for k, v in self.w.items()}
        loss = 0.0
        for step in range(1, steps + 1):
            own = rng.choice(len(label), size=min(size, 4 * len(label)), p=share)
            loss, grad = self.gradients(windows[own], label[own])
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            pace = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for k, g in grad.items():
                g = g / max(1.0, norm)
                mean[k] = 0.9 * mean[k] + 0.1 * g
                square[k] = 0.99 * square[k] + 0.01 * g * g
                self.w[k] -= (pace * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return loss


def cuts(texts: pa.Array, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of a text array, and begin, end and row of each window of at most ``window`` bytes of one text."""
    raw = texts.cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset:raw.offset + len(raw) + 1] if len(raw) else np.zeros(1, np.int64)
    data = np.frombuffer(raw.buffers()[2], np.uint8) if raw.buffers()[2] is not None else np.empty(0, np.uint8)
    parts = -(-np.diff(offsets) // window)
    row = np.repeat(np.arange(len(parts)), parts)
    begin = np.repeat(offsets[:-1], parts) + window * (np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts))
    return data, begin, np.minimum(begin + window, np.repeat(offsets[1:], parts)), row


def gather(data: np.ndarray, begin: np.ndarray, stop: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Windows (n, window) of bytes, padded."""
    at = begin[:, None] + np.arange(window)
    inside = at < stop[:, None]
    out = np.full(at.shape, PAD, np.int16)
    out[inside] = data[at[inside]]
    return out


def windows_of(texts: pa.Array, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """All windows of a text array, and the row of each."""
    data, begin, stop, row = cuts(texts, window)
    return gather(data, begin, stop, window), row


def train(docs: DataFrame, folds: int = 3, held: int = 1, per_label: int = PER_LABEL, chars: int = CHARS) -> Network | None:
    """Learns from ``text`` and ``lang`` of rows outside the held fold: ``per_label`` rows of each language, by a hash order."""
    usable = docs.filter(F.col("lang").isNotNull() & (F.pmod(held_out_key("doc_id"), F.lit(folds)) != held))
    usable = usable.select(F.col("lang").cast("string").alias("lang"), F.xxhash64("doc_id").alias("_order"), "text")
    # of a frequent language only a share by hash goes to the ranking, about SPARE times what it takes
    share = keep(usable.groupBy("lang").agg((F.lit(float(SPARE * per_label)) / F.count("*")).alias("_share")), "languages")
    rows = usable.join(share, "lang").filter(F.pmod("_order", F.lit(1 << 30)) < F.col("_share") * (1 << 30)).filter(F.length(F.trim("text")) > 0).select(
        "lang", "_order", F.expr(f"substring(text, int(1 + pmod(_order, greatest(1, length(text) - {chars}))), {chars})").alias("text")
    )
    first = Window.partitionBy("lang").orderBy("_order", "text")
    sample = rows.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= per_label).drop("_n").toArrow()
    if not sample.num_rows:
        return None
    lang = np.array(sample.column("lang").to_pylist())
    labels = sorted(set(lang.tolist()))
    windows, row = windows_of(sample.column("text").combine_chunks().cast(pa.string()))
    network = Network(labels)
    network.fit(windows, np.searchsorted(labels, lang)[row])
    return network


def label_texts(network: Network, texts: pa.Array, at_once: int = 1024) -> np.ndarray:
    """(row, label): mean probabilities over all positions of each text; zeros for empty ones. Holds ``at_once`` windows."""
    data, begin, stop, row = cuts(texts)
    total = np.zeros((len(texts), len(network.labels)))
    for at in range(0, len(row), at_once):
        own = slice(at, at + at_once)
        windows = gather(data, begin[own], stop[own])
        p = network.positions(windows)
        p *= windows.T != PAD
        low = row[at]
        for k, sums in enumerate(p.sum(axis=1, dtype=np.float64)):
            found = np.bincount(row[own] - low, sums)
            total[low:low + len(found), k] += found
    size = np.bincount(row, stop - begin, len(texts))
    return total / np.maximum(size, 1)[:, None]


def predict(docs: DataFrame, network: Network | None) -> DataFrame:
    """(doc_id, lang_pred, score) per row of ``docs`` (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if network is None or not network.labels:
        return rows.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = np.array(network.labels)
        for batch in batches:
            share = label_texts(network, batch.column("text"))
            best = share.argmax(axis=1)
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(labels[best].tolist(), pa.string()), pa.array(np.round(share.max(axis=1), 6).clip(0, 1))],
                names=["doc_id", "lang_pred", "score"],
            )

    # texts without letters go to the network as null: nothing to read
    read = rows.select("doc_id", F.when(F.col("text").rlike(r"\p{L}"), F.col("text")).alias("text"))
    found = read.mapInArrow(run, "doc_id long, lang_pred string, score double")
    return found.withColumn("lang_pred", F.when(F.col("score") > 0, F.col("lang_pred")).otherwise(UNKNOWN))


def keep_known(docs: DataFrame, network: Network | None, least: float) -> DataFrame:
    """Rows of ``docs``, all columns, whose best language has at least the mean probability ``least``; without a network none."""
    if network is None:
        return docs.limit(0)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            letters = pa.compute.match_substring_regex(batch.column(at), r"\p{L}").fill_null(False)
            read = pa.compute.if_else(letters, batch.column(at), pa.scalar(None, batch.column(at).type))
            known = label_texts(network, read).max(axis=1) >= least
            yield batch.filter(pa.compute.and_(letters, pa.array(known)))

    return docs.mapInArrow(run, docs.schema)


def identify(docs: DataFrame, folds: int = 3, held: int = 1, per_label: int = PER_LABEL, chars: int = CHARS) -> DataFrame:
    """Trains outside the held fold and labels every row: (doc_id, held_out, lang_pred, score)."""
    found = predict(docs, train(docs, folds, held, per_label, chars))
    return found.select("doc_id", F.coalesce(F.pmod(held_out_key("doc_id"), F.lit(folds)) == held, F.lit(False)).alias("held_out"), "lang_pred", "score")
