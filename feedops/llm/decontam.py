"""Benchmark decontamination: a broadcast hash set of test word windows, looked up by the windows of every document.

Words are runs of digits, a-z (A-Z folded) and anything beyond ASCII. Windows of ``size`` consecutive item words go into
the set (an item with fewer words is one window of its own length). Words are numbered on the driver and sent as one
broadcast; a document's words become numbers (0: in no item), windows are hashed with numpy and each hit is verified
word by word. If the test set is larger than ``SLICE_BYTES`` it is taken in slices of that size, one pass each, so a
broadcast never grows with the test set; the hit words of the passes are united per document.

Null or empty texts have no words and are clean. Null item texts and items without words have no windows; an item id may
stand in several rows. Rows without an item id are one item together: their windows hit and count, their hash part is none. Ties and repeated rows are judged row by row; extra columns stay out of the report.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedops.llm.common import each_slice

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: A slice of the test set that is broadcast at once.
SLICE_BYTES = 32_000_000
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes | None) -> list[bytes]:
    return WORD.findall(text.lower()) if text else []


class Windows:
    """The windows of some items, by length: sorted hashes, the numbers of their words, the items they stand in."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], size: int):
        self.number: dict[bytes, int] = {}
        found: dict[int, dict[tuple[int, ...], list[str]]] = {}
        for item, words in items:
            ids = [self.number.setdefault(w, len(self.number) + 1) for w in words]
            length = min(size, len(ids))
            for at in range(len(ids) - length + 1 if length else 0):
                owners = found.setdefault(length, {}).setdefault(tuple(ids[at:at + length]), [])
                if item not in owners:
                    owners.append(item)
        self.by_length = {}
        for length, grams in found.items():
            ids = np.array(list(grams), np.int64).reshape(-1, length)
            hashes = window_hash(ids.reshape(-1), length)[::length] if len(ids) else np.empty(0, np.uint64)
            order = np.argsort(hashes, kind="stable")
            owners = list(grams.values())
            self.by_length[length] = (hashes[order], ids[order], [owners[k] for k in order])

    @staticmethod
    def of(parts: dict) -> Windows:
        """From the plain parts that a broadcast carries."""
        made = Windows([], 1)
        made.number, made.by_length = parts["number"], parts["by_length"]
        return made

    def hits(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Which words stand in an occurrence of a window, and the items with one."""
        ids = np.fromiter((self.number.get(w, 0) for w in words), np.int64, len(words))
        edge, items = np.zeros(len(words) + 1, np.int32), set()
        if not ids.any():
            return edge[:-1] > 0, items
        for length, (hashes, grams, owners) in self.by_length.items():
            if len(ids) < length:
                continue
            unknown = np.cumsum(np.r_[0, ids == 0])
            at = np.flatnonzero(unknown[length:] == unknown[:-length])
            if not len(at):
                continue
            own = window_hash(ids, length)[at]
            first, stop = np.searchsorted(hashes, own, "left"), np.searchsorted(hashes, own, "right")
            for k in np.flatnonzero(first < stop).tolist():
                start = int(at[k])
                for g in range(int(first[k]), int(stop[k])):
                    if np.array_equal(grams[g], ids[start:start + length]):
                        edge[start] += 1
                        edge[start + length] -= 1
                        items.update(owners[g])
        return np.cumsum(edge[:-1]) > 0, items


def window_hash(ids: np.ndarray, length: int) -> np.ndarray:
    """A hash of each run of ``length`` numbers."""
    out = np.zeros(max(0, len(ids) - length + 1), np.uint64)
    for k in range(length):
        out = out * FACTOR + ids[k:k + len(out)].astype(np.uint64) + np.uint64(1)
        out ^= out >> np.uint64(29)
    return out


def _slices(benchmark: DataFrame, size: int, limit: int) -> Iterator[Windows]:
    """Items in slices of bounded size; a long item is cut, its windows overlapping the cut."""
    held, room = [], 0
    for row in benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("string").alias("t")).toLocalIterator():
        words = words_of(row.t.encode("utf-8", "surrogatepass") if row.t is not None else None)
        if not words:
            continue
        step = max(size, limit // 64)
        for at in range(0, max(1, len(words) - size + 1), step):
            piece = words[at:at + step + size - 1]
            held.append((row.i, piece))
            room += 64 * len(piece)
            if room >= limit:
                yield Windows(held, size)
                held, room = [], 0
    yield Windows(held, size)


def _report(words: int, hit: np.ndarray, items: set[str]) -> tuple:
    return words, int(hit.sum()), len(items), hashlib.sha256(",".join(sorted(i for i in items if i is not None)).encode()).hexdigest()


def _judged(texts: pa.Array, slices: list) -> list[tuple[np.ndarray, set[str]]]:
    """Hit words and items of each text, slice after slice of the test set."""
    found = None
    for parts in each_slice(slices):
        own = Windows.of(parts)
        now = [own.hits(words_of(text.as_py())) for text in texts.cast(pa.binary())]
        found = now if found is None else [(a | c, b | d) for (a, b), (c, d) in zip(found, now)]
    return found


def scan(docs: DataFrame, benchmark: DataFrame, size: int = 10, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) per row of ``docs`` (doc_id, text)."""
    context = docs.sparkSession.sparkContext
    slices = [context.broadcast(vars(w)) for w in _slices(benchmark, size, slice_bytes)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_report(len(hit), hit, items) for hit, items in _judged(batch.column(1), slices)]
            yield pa.record_batch(
                [batch.column(0), *(pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string())))],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string").withColumn("contaminated", F.col("n_hit") > 0)


def clean(docs: DataFrame, benchmark: DataFrame, size: int = 10, remove: str = "documents", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """``docs`` without what stands in the benchmark, same columns.

    ``remove="documents"`` leaves out every document with a hit; ``"spans"`` cuts the hit words (with what stands between
    them) out of the text and puts a line break in their place. Other rows and columns stay as they are.
    """
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove must be documents or spans, not {remove!r}")
    context = docs.sparkSession.sparkContext
    slices = [context.broadcast(vars(w)) for w in _slices(benchmark, size, slice_bytes)]
    text_at, schema = docs.columns.index("text"), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = [hit for hit, _ in _judged(batch.column(text_at), slices)]
            if remove == "documents":
                yield batch.filter(pa.array([not hit.any() for hit in hits], pa.bool_()))
                continue
            raw = batch.column(text_at).cast(pa.binary()).to_pylist()
            texts = pa.array([cut(t, hit) if hit.any() else t for t, hit in zip(raw, hits)], pa.binary()).cast(pa.string())
            columns = [texts if k == text_at else c for k, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, schema)


def cut(text: bytes, hit: np.ndarray) -> bytes:
    """``text`` with every run of hit words replaced by a line break."""
    out, at, inside = [], 0, False
    for word, bad in zip(WORD.finditer(text.lower()), hit.tolist()):
        if bad and not inside:
            out += [text[at:word.start()], b"\n"]
        if bad:
            at = word.end()
        inside = bad
    return b"".join([*out, text[at:]])
