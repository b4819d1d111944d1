"""Compression of vectors into short codes: one codebook per part of a vector, learned by ball k-means.

A vector is cut into ``PARTS`` equal consecutive parts; each part gets the number of its nearest entry in the codebook of its
position. Each entry is the centre of a ball that holds the parts assigned to it. The radius of a ball (the distance of its farthest
part) tells its neighbours: entries so far away that half their distance exceeds the radius cannot win any part of the ball.

- A ball without neighbours, or whose entry and neighbours did not move since the last round, is skipped as a whole.
- The stable core of a ball, up to half the distance to its nearest neighbour, stays where it is.
- The rest lies in annular rings between the half distances to the neighbours in order; a part in the i-th ring is compared
  with the first i neighbours only.

All distances are squared and whole, so the tests are exact; equal distances go to the lower index. Balls are those of a block of
rows: vectors are packed into blocks once, and blocks lie bucketed in the shared folder; a round joins each block with its codes and
radii of the round before without a shuffle, and writes the new codes. Only sums by (position, entry, component) are shuffled.

Vectors that are null or hold null or non-finite components are dropped. A component x becomes floor(``scale`` * x) in double precision,
held within +-2^27. The length that counts is the most frequent one that the number of parts divides (the smaller at a tie, zero never);
vectors of other lengths keep their row with null code and error. The first entries are the parts of the ``k`` rows with the
smallest vec_id (components decide between equal ids, rows without vec_id are left out); fewer rows give fewer entries.
Repeated rows are vectors of their own; extra columns are ignored. Sums over rows end at the largest long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedops.llm.centroids import LONGEST, finite, whole_numbers
from feedops.llm.common import keep, keep_bucketed

PARTS = 8
ENTRIES = 16
SCALE = 4096
ROUNDS = 6
BLOCK = 4096
UNKNOWN = -1


def squared(x: np.ndarray, entry: np.ndarray) -> np.ndarray:
    return ((x - entry) ** 2).sum(1)


def ball_round(x: np.ndarray, own: np.ndarray, radius: np.ndarray, entries: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """One assignment of the parts ``x`` of a position: (entry of each, squared radii, exact distances computed).

    ``own`` is the entry of each part in the round before, ``radius`` a bound of the squared radii then (``UNKNOWN``: none),
    ``moved`` tells which entries have changed since.
    """
    out, after, work = own.copy(), np.full(len(entries), UNKNOWN, np.int64), 0
    between = ((entries[:, None] - entries[None]) ** 2).sum(2)
    np.fill_diagonal(between, LONGEST)
    for g in np.unique(own).tolist():
        if radius[g] >= 0 and not moved[g] and not moved[between[g] <= 4 * radius[g]].any():
            after[g] = max(after[g], radius[g])
            continue
        members = np.flatnonzero(own == g)
        best = squared(x[members], entries[g])
        work += len(members)
        near = np.flatnonzero(between[g] <= 4 * best.max())
        near = near[np.argsort(between[g][near], kind="stable")]
        ring = np.searchsorted(between[g][near], 4 * best, "right")
        who = np.full(len(members), g)
        for nth, j in enumerate(near.tolist()):
            rows = np.flatnonzero(ring > nth)
            if not len(rows):
                break
            exact = squared(x[members[rows]], entries[j])
            work += len(rows)
            nearer = (exact < best[rows]) | ((exact == best[rows]) & (j < who[rows]))
            best[rows[nearer]], who[rows[nearer]] = exact[nearer], j
        out[members] = who
        np.maximum.at(after, who, best)
    return out, after, work


def _packed(dim: int, scale: int):
    """Task: vectors in blocks, numbered by task and place."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            x = whole_numbers(batch.column("x"), dim, scale).astype(np.int32)
            for begin in range(0, len(x), BLOCK):
                rows = slice(begin, begin + BLOCK)
                n = len(x[rows])
                yield pa.record_batch([
                    pa.array([number]), pa.array([batch.column("vec_id").slice(begin, n).to_pylist()], pa.list_(pa.int64())),
                    pa.array([batch.column("label").slice(begin, n).to_pylist()], pa.list_(pa.string())), pa.array([x[rows].tobytes()], pa.binary()),
                ], names=["block", "ids", "labels", "x"])
                number += 1

    return run


class State:
    """Codes and squared radii of a block, position by position."""

    def __init__(self, codes: bytes | None, radii: bytes | None, n: int, parts: int, entries: int):
        self.codes = np.zeros((n, parts), np.int64) if codes is None else np.frombuffer(codes, np.uint8).reshape(n, parts).astype(np.int64)
        self.radii = np.full((parts, entries), UNKNOWN, np.int64) if radii is None else np.frombuffer(radii, np.int64).reshape(parts, entries).copy()

    def advance(self, x: np.ndarray, books: np.ndarray, moved: np.ndarray) -> None:
        for p, entries in enumerate(books):
            self.codes[:, p], self.radii[p], _ = ball_round(x[:, p], self.codes[:, p], self.radii[p], entries, moved[p])


def _blocks(batches: Iterator[pa.RecordBatch], books: np.ndarray, moved: np.ndarray) -> Iterator[tuple[dict, np.ndarray, State]]:
    """Blocks with their vectors as (row, part, component) and the state after an assignment to ``books``."""
    parts, entries, width = books.shape
    for batch in batches:
        for k in range(batch.num_rows):
            row = {name: batch.column(name)[k].as_py() for name in batch.schema.names}
            x = np.frombuffer(row["x"], np.int32).reshape(-1, parts, width).astype(np.int64)
            state = State(row.get("codes"), row.get("radii"), len(x), parts, entries)
            state.advance(x, books, moved)
            yield row, x, state


def _round(books: np.ndarray, moved: np.ndarray):
    """Task: codes and radii of each block after an assignment, and its counts and sums for the new entries."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, entries, width = books.shape
        for row, x, state in _blocks(batches, books, moved):
            sums = np.zeros((parts, entries, width + 1), np.int64)
            for p in range(parts):
                sums[p, :, 0] = np.bincount(state.codes[:, p], minlength=entries)
                np.add.at(sums[p, :, 1:], state.codes[:, p], x[:, p])
            yield pa.record_batch([
                pa.array([row["block"]]), pa.array([state.codes.astype(np.uint8).tobytes()], pa.binary()),
                pa.array([state.radii.tobytes()], pa.binary()), pa.array([sums.tobytes()], pa.binary()),
            ], names=["block", "codes", "radii", "sums"])

    return run


def _cells(size: int):
    """Task: the sums of its blocks by place."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for one in batch.column("sums"):
                total += np.frombuffer(one.as_buffer(), np.int64)
        yield pa.record_batch([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], names=["place", "amount"])

    return run


def _coded(books: np.ndarray, moved: np.ndarray):
    """Task: the rows of each block with code and error after the last assignment."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, x, state in _blocks(batches, books, moved):
            error = sum(squared(x[:, p], books[p][state.codes[:, p]]) for p in range(len(books)))
            code = ["".join(f"{c:02x}" for c in own) for own in state.codes.tolist()]
            yield pa.record_batch([pa.array(row["ids"], pa.int64()), pa.array(row["labels"], pa.string()), pa.array(code, pa.string()), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    return run


def compress(vectors: DataFrame, parts: int = PARTS, k: int = ENTRIES, scale: int = SCALE, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """Rows (vec_id, label, code, error) of ``vectors`` (vec_id, embedding, label) and the codebooks (position, entry, component)."""
    spark = vectors.sparkSession
    schema = "vec_id long, label string, code string, error long"
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("x")
    ).filter(finite(F.col("x")))
    lengths = rows.groupBy(F.size("x").alias("n")).count().filter(f"n > 0 AND n % {parts} = 0").orderBy(F.desc("count"), "n").limit(1).collect()
    fits = F.size("x") == (lengths[0]["n"] if lengths else -1)
    others = rows.filter(~fits).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    if not lengths:
        return others, np.zeros((parts, 0, 0), np.int64)
    dim = lengths[0]["n"]
    first = rows.filter(fits & F.col("vec_id").isNotNull()).orderBy("vec_id", "x").limit(k).select("x").toArrow().column("x").combine_chunks()
    if not len(first):
        return rows.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error")), np.zeros((parts, 0, 0), np.int64)
    books = whole_numbers(first, dim, scale).reshape(-1, parts, dim // parts).transpose(1, 0, 2).copy()
    entries, width = books.shape[1:]
    blocks = keep_bucketed(
        rows.filter(fits).mapInArrow(_packed(dim, scale), "block long, ids array<long>, labels array<string>, x binary"), "blocks", "block"
    )
    state, moved = None, np.ones((parts, entries), bool)
    size = parts * entries * (width + 1)
    for _ in range(rounds):
        at = blocks.select("block", "x")
        at = at if state is None else at.join(state.select("block", "codes", "radii"), "block")
        state = keep_bucketed(at.mapInArrow(_round(books, moved), "block long, codes binary, radii binary, sums binary"), "codes", "block")
        found = state.select("sums").mapInArrow(_cells(size), "place int, amount long").groupBy("place").agg(F.sum("amount").alias("amount")).toArrow()
        sums = np.zeros(size, np.int64)
        sums[found.column("place").to_numpy()] = found.column("amount").to_numpy()
        sums = sums.reshape(parts, entries, width + 1)
        count = sums[:, :, :1]
        after = np.where(count > 0, sums[:, :, 1:] // np.maximum(count, 1), books)
        moved, books = (after != books).any(2), after
    at = blocks if state is None else blocks.join(state.select("block", "codes", "radii"), "block")
    return at.mapInArrow(_coded(books, moved), schema).unionByName(others), books


def digest(books: np.ndarray) -> str:
    """sha256 over the decimal components by position, entry and place."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def codes(vectors: DataFrame, **how) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) per row that ``compress`` keeps."""
    found, books = compress(vectors, **how)
    found = keep(found, "coded")
    total = F.sum(F.col("error").cast("decimal(28,0)"))
    held = F.when(total > LONGEST, LONGEST).otherwise(total).cast("long")
    by_label = keep(found.groupBy("label").agg(held.alias("label_error")), "labels").withColumnRenamed("label", "of")
    return found.join(by_label, F.col("label").eqNullSafe(F.col("of")), "left").select(
        "vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256")
    )
