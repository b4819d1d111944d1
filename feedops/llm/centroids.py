"""Clusters of embeddings by rounds of nearest centroids, each found by the threshold algorithm over sorted lists.

Every dimension has a list of the centroids sorted by their value there. For a vector the lists are walked outward from its own
value, the nearer side first. A centroid met in any list gets its exact distance at once. The next entries of all lists form the
frontier: no centroid unmet so far can be nearer than the sum of their squared gaps. The walk of a vector ends when that sum
strictly exceeds its best exact distance (a tie could still go to a smaller number), or when all centroids were met.

Vectors count if they have exactly ``size`` components, none null or non-finite. A component x becomes floor(``scale`` * x),
in double precision, held within +-2^27 so that every squared distance fits a long; sums over rows end at the largest long.
First centroids: the ``k`` vectors with the smallest sha256 of ``1:<vec_id>``; rows that share a vec_id stand in the order of their
components, and rows without vec_id are never first centroids but are assigned like others. With fewer than ``k`` vectors there are
fewer centroids; where no vector has a vec_id there are none and no rows. Repeated rows are vectors of their own; extra columns are ignored.

A round reads the vectors once; only sums by (cluster, dimension) are shuffled, and ``k * size`` numbers reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedops.llm.common import keep

K = 16
SIZE = 64
SCALE = 64
ROUNDS = 3
STRIDE = 8
MOST = 2**27
LONGEST = 2**63 - 1


def finite(x: Column) -> Column:
    """Neither null nor holding null or non-finite components."""
    return F.coalesce(x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & (F.abs(v) < float("inf"))), F.lit(False))


def whole_numbers(lists: pa.Array, size: int, scale: int) -> np.ndarray:
    """Rows of floor(scale * x) within +-``MOST``."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.clip(np.floor(flat * scale), -MOST, MOST).astype(np.int64).reshape(-1, size)


class Lists:
    """Centroids with one sorted list per dimension."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.order = np.argsort(centroids, axis=0, kind="stable")
        self.values = np.take_along_axis(centroids, self.order, 0)

    def nearest(self, x: np.ndarray, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
        """(centroid, squared distance) of each row of ``x``; ties go to the smaller number."""
        n, dims = x.shape
        k = len(self.centroids)
        best, who = np.full(n, LONGEST), np.full(n, k)
        if not n:
            return who, best
        right = np.stack([np.searchsorted(self.values[:, d], x[:, d], "left") for d in range(dims)], 1)
        left = right - 1
        far = 4 * MOST

        def gaps(rows: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Gaps to the next entry below and above; ``far`` where a list has no more."""
            at, to = left[np.ix_(rows, own)], right[np.ix_(rows, own)]
            here = x[np.ix_(rows, own)]
            below = np.where(at >= 0, here - self.values[at.clip(0), own], far)
            return below, np.where(to < k, self.values[to.clip(max=k - 1), own] - here, far)

        every, active = np.arange(dims), np.arange(n)
        below, above = gaps(active, every)
        frontier = np.minimum(below, above)
        met = np.zeros((n, k), bool)
        first = 0
        while len(active):
            own = every[first:first + stride]
            first = first + stride if first + stride < dims else 0
            below, above = gaps(active, own)
            down = below <= above
            at = np.where(down, left[np.ix_(active, own)], right[np.ix_(active, own)])
            there = (at >= 0) & (at < k)
            found = np.zeros((len(active), k), bool)
            row, column = np.nonzero(there)
            found[row, self.order[at[row, column], own[column]]] = True
            found &= ~met[active]
            met[active] |= found
            for c in np.flatnonzero(found.any(0)).tolist():
                rows = active[found[:, c]]
                exact = ((x[rows] - self.centroids[c]) ** 2).sum(1)
                nearer = (exact < best[rows]) | ((exact == best[rows]) & (c < who[rows]))
                best[rows[nearer]], who[rows[nearer]] = exact[nearer], c
            left[np.ix_(active, own)] -= down & there
            right[np.ix_(active, own)] += ~down & there
            frontier[np.ix_(active, own)] = np.minimum(*gaps(active, own))
            bound = (np.minimum(frontier[active], far).astype(np.float64) ** 2).sum(1)
            # the float sum only decides when it is beyond doubt; equal and near sums walk on
            active = active[~((bound > best[active] * (1 + 1e-9) + 1) | met[active].all(1))]
        return who, best


def _summed(centroids: np.ndarray, scale: int):
    """Task: sums by (cluster, dimension), the row counts standing at dimension -1."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = Lists(centroids)
        k, size = centroids.shape
        total, count = np.zeros((k, size), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            x = whole_numbers(batch.column("x"), size, scale)
            who, _ = lists.nearest(x)
            np.add.at(total, who, x)
            count += np.bincount(who, minlength=k)
        used = np.flatnonzero(count)
        yield pa.record_batch([
            pa.array(np.repeat(used, size + 1).astype(np.int32)), pa.array(np.tile(np.arange(-1, size, dtype=np.int32), len(used))),
            pa.array(np.c_[count[used], total[used]].reshape(-1)),
        ], names=["cluster", "dim", "amount"])

    return run


def _assigned(centroids: np.ndarray, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = Lists(centroids)
        for batch in batches:
            who, distance = lists.nearest(whole_numbers(batch.column("x"), centroids.shape[1], scale))
            yield pa.record_batch([batch.column("vec_id"), pa.array(who.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return run


def first_centroids(rows: DataFrame, k: int, size: int, scale: int) -> np.ndarray:
    hashed = rows.filter("vec_id IS NOT NULL").withColumn("h", F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256))
    chosen = hashed.orderBy("h", "x").limit(k).select("x").toArrow().column("x").combine_chunks()
    return whole_numbers(chosen, size, scale)


def cluster(vectors: DataFrame, k: int = K, size: int = SIZE, scale: int = SCALE, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) per vector of ``vectors`` (vec_id, embedding) that counts."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
    rows = rows.filter(finite(F.col("x")) & (F.size("x") == size))
    centroids = first_centroids(rows, k, size, scale)
    for _ in range(rounds if len(centroids) else 0):
        sums = rows.select("x").mapInArrow(_summed(centroids, scale), "cluster int, dim int, amount long")
        found = sums.groupBy("cluster", "dim").agg(F.sum("amount").alias("amount")).toArrow()
        at, dim, amount = (found.column(c).to_numpy() for c in ("cluster", "dim", "amount"))
        total, count = np.zeros((len(centroids), size), np.int64), np.zeros(len(centroids), np.int64)
        count[at[dim < 0]] = amount[dim < 0]
        total[at[dim >= 0], dim[dim >= 0]] = amount[dim >= 0]
        used = count > 0
        centroids = centroids.copy()
        centroids[used] = total[used] // count[used][:, None]
    schema = "vec_id long, cluster int, distance long"
    if not len(centroids):
        # no row has both a vec_id and a sound vector: those without vec_id have nothing to be assigned to
        none = spark.createDataFrame([], schema)
        return none.select("*", *[F.lit(None).cast("long").alias(c) for c in ("cluster_inertia", "inertia")], F.lit(None).cast("string").alias("centroid_sha256"))
    assigned = keep(rows.mapInArrow(_assigned(centroids, scale), schema), "centroids")

    def held(amount: Column) -> Column:
        return F.least(amount, F.lit(LONGEST).cast("decimal(38,0)")).cast("long")

    # at most k rows, so the sums may be broadcast
    by_cluster = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(28,0)")).alias("own"))
    digests = [(c, hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for c, x in enumerate(centroids.tolist())]
    totals = by_cluster.join(spark.createDataFrame(digests, "cluster int, centroid_sha256 string"), "cluster").select(
        "cluster", held(F.col("own")).alias("cluster_inertia"), held(F.sum("own").over(Window.partitionBy(F.lit(0)))).alias("inertia"), "centroid_sha256"
    )
    return assigned.join(F.broadcast(totals), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
