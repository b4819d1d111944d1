"""Near copies by SimHash: an inverted index over (byte position, byte) with count filtering.

A 64-bit fingerprint has 8 bytes. Two that differ in at most ``most`` bits differ in at most ``most`` bytes, so at least
``8 - most`` positions hold the same byte: the guaranteed number of matches. Posting lists of single bytes would bring
nearly all pairs together, so a posting here is a set of ``width`` positions with their bytes: a pair that shares at least
``need`` of 8 positions shares all of some ``width``-subset of any ``8 - need + width`` positions, hence only subsets of
the first so many positions are indexed, and no pair can be missed. For each pair in a posting the shared positions are
tallied; pairs that reach the minimum are verified bit by bit.

Equal fingerprints are one entry, so thousands of copies cost what one does. A posting with very many different
fingerprints is dealt out in blocks, and a task passes on a few links that connect the same documents instead of all pairs.

Null, empty or blank texts have fingerprint zero and link like any other. Texts with fewer words than a shingle are one
shingle. Rows without a doc_id have no name to link by: their component is null. Repeated rows get the same result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedops.llm.common import Forest, bucket_chunks, components, dealt, keep, pairs_inside, split_hot

SEED = 42
BYTES = 8
#: Positions of a posting where few fingerprints are compared. Unrelated fingerprints fall into one posting with chance
#: 256^-width, so each meets no more than a few others up to 2^25 of them; beyond that a posting takes one position more.
WIDTH = 3
#: Shingles of a text that are hashed at once.
AT_ONCE = 1 << 16


def fingerprint(text: bytes | None, words: int = 4) -> int:
    """Majority of the bits of XXH64 over the shingles of one text."""
    own = text.lower().split() if text else []
    if not own:
        return 0
    line = b" ".join(own)
    if len(own) <= words:
        return xxhash.xxh64_intdigest(line, SEED)
    size = np.fromiter(map(len, own), np.int64, len(own))
    stop = np.cumsum(size + 1) - 1
    start = stop - size
    digest, ones, count = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(own) - words + 1
    for at in range(0, count, AT_ONCE):
        last = min(count, at + AT_ONCE)
        hashes = [digest(line[a:b], SEED) for a, b in zip(start[at:last].tolist(), stop[at + words - 1:last + words - 1].tolist())]
        column = np.array(hashes, "<u8").view(np.uint8).reshape(-1, BYTES)
        ones += np.unpackbits(column, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > count, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, fp): the 64 bits as a long, one row per row of ``docs`` (doc_id, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            found = np.fromiter((fingerprint(t.as_py(), words) for t in texts), np.uint64, batch.num_rows)
            yield pa.record_batch([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def posting_masks(most: int, width: int) -> list[int]:
    """Byte masks of the indexed position sets."""
    need = BYTES - most
    if not 0 < width <= need:
        raise ValueError(f"a posting of {width} bytes needs at least as many guaranteed matches; there are {need}")
    return [sum(0xFF << 8 * p for p in positions) for positions in combinations(range(BYTES - need + width), width)]


def posting_width(n: int, most: int) -> int:
    """Positions of a posting for ``n`` different fingerprints: as few as keep chance meetings in proportion to n."""
    width = WIDTH
    while n > 1 << 8 * width + 1:
        width += 1
    return min(width, BYTES - most)


def _verified(most: int):
    """Task over sorted postings: tallies shared bytes of each pair, verifies, and returns connecting links."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Forest()
        for table in bucket_chunks(batches):
            bucket, part, side, doc = (table.column(c).to_numpy() for c in ("bucket", "part", "side", "doc"))
            fp = table.column("fp").to_numpy().view(np.uint64)
            for left, right in pairs_inside(bucket, part, side):
                differ = fp[left] ^ fp[right]
                shared = (differ[:, None].view(np.uint8) == 0).sum(axis=1)
                enough = np.flatnonzero(shared >= BYTES - most)
                enough = enough[np.bitwise_count(differ[enough]) <= most]
                if len(enough):
                    found.add(doc[left[enough]], doc[right[enough]])
        a, b = found.links()
        yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def links(distinct: DataFrame, most: int = 4, width: int = WIDTH) -> DataFrame:
    """(a, b): links that connect the documents of ``distinct`` (fp, doc), fingerprints unique, within ``most`` bits."""
    mask = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for k, m in enumerate(posting_masks(most, width))]))
    postings = distinct.select("fp", "doc", mask.alias("m")).select(F.xxhash64("m.k", "m.key").alias("bucket"), "fp", "doc")
    return dealt(split_hot(postings)).mapInArrow(_verified(most), "a long, b long")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def near_copies(docs: DataFrame, most: int = 4, words: int = 4, width: int | None = None) -> DataFrame:
    """(doc_id, fingerprint, component_id) per row: 16 hex digits; the smallest doc_id reachable by links.

    ``width`` changes the cost and never the links; None takes it from the number of fingerprints.
    """
    own = keep(fingerprints(docs, words), "fingerprints")
    distinct = keep(own.filter("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("doc")), "distinct-fingerprints")
    roots = components(links(distinct, most, posting_width(distinct.count(), most) if width is None else width))
    named = distinct.join(roots.withColumnRenamed("node", "doc"), "doc", "left").select("fp", F.coalesce("root", "doc").alias("component_id"))
    return own.join(named, "fp", "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
    )


def keep_first(docs: DataFrame, most: int = 4, words: int = 4, width: int | None = None) -> DataFrame:
    """Rows of ``docs`` less those that are near copies of a document with a smaller doc_id.

    Rows that share a doc_id are one document: they go together, and one of them stays. Rows without a doc_id stay.
    """
    return first_of_each(docs, near_copies(docs, most, words, width).select("doc_id", "component_id"))


def first_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """As ``keep_first``, by the components of ``found`` (doc_id, component_id)."""
    found = keep(found, "near-copies")
    # one plan at every size: rows are shuffled once, whatever the number of copies
    gone = found.filter("doc_id <> component_id").select("doc_id").distinct().hint("merge")
    rest = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    repeated = keep(found.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return rest
    again = rest.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*docs.columns)
    return rest.join(repeated, "doc_id", "left_anti").select(*docs.columns).unionByName(again)
