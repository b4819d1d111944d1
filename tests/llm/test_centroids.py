import hashlib
import math
from collections import Counter

import numpy as np
import pytest

from feedops.llm.centroids import MOST, Lists, cluster

VECTORS = "vec_id long, embedding array<double>, label int"


def plain(rows, k, size, scale, rounds):
    """One vector after the other, every centroid compared."""
    kept = [(i, [max(-MOST, min(MOST, math.floor(scale * v))) for v in x]) for i, x in rows
            if x is not None and len(x) == size and all(v is not None and math.isfinite(v) for v in x)]
    own = sorted((r for r in kept if r[0] is not None), key=lambda r: (hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [x for _, x in own[:k]]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        members = {}
        for _, x in kept:
            members.setdefault(nearest(x)[1], []).append(x)
        centroids = [[sum(v) // len(members[n]) for v in zip(*members[n])] if n in members else c for n, c in enumerate(centroids)]
    found = [(i, *nearest(x)) for i, x in kept]
    inertia = Counter()
    for _, d, c in found:
        inertia[c] += d
    total = sum(d for _, d, _ in found)
    return sorted((i is not None, i, c, d, inertia[c], total, hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for i, d, c in found)


def got(df):
    return sorted((r[0] is not None, *r) for r in df.collect())


@pytest.mark.parametrize("seed", range(6))
def test_walk_finds_the_nearest(seed):
    rng = np.random.default_rng(seed)
    k, dims, spread = int(rng.integers(1, 20)), int(rng.integers(1, 70)), int(rng.choice([2, 50, MOST]))
    centroids = rng.integers(-spread, spread + 1, (k, dims))
    x = np.concatenate([rng.integers(-spread, spread + 1, (200, dims)), centroids, centroids[:1]])
    who, distance = Lists(centroids).nearest(x, stride=int(rng.integers(1, dims + 1)))
    exact = ((x[:, None] - centroids[None]) ** 2).sum(2)
    assert np.array_equal(distance, exact.min(1)) and np.array_equal(who, exact.argmin(1))


def test_walk_stops_early():
    centroids = np.arange(16)[:, None] * 1000 + np.zeros(8, int)
    lists = Lists(centroids)
    met = []
    lists.centroids = type("Seen", (np.ndarray,), {"__getitem__": lambda s, c: met.append(c) or np.ndarray.__getitem__(s, c)})(centroids.shape, centroids.dtype, centroids.copy())
    lists.nearest(np.full((1, 8), 3010))
    assert 0 < len(met) < 16


def test_rounds_equal_plain(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in rng.normal(0, 1, 4)], 0) for i in range(300)]
    rows += rows[:20] + [(900 + i, rows[5][1], 1) for i in range(150)]
    expected = plain([r[:2] for r in rows], 7, 4, 64, 3)
    assert got(cluster(spark.createDataFrame(rows, VECTORS).repartition(5), k=7, size=4)) == expected


def test_odd_rows(spark):
    x = [[1.0, 2.0], [1.0, 2.0], [-3.5, 0.0], None, [], [1.0], [1.0, None], [1.0, float("nan")], [float("inf"), 1.0], [1e300, -1e300], [0.0, 0.0]]
    rows = [(i if i != 10 else None, v, None) for i, v in enumerate(x)]
    rows += [rows[0], (2, [7.0, 7.0], 1)]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], VECTORS + ", cluster int, x string, distance int")
    assert got(cluster(df, k=3, size=2)) == plain([r[:2] for r in rows], 3, 2, 64, 3)


def test_no_rows(spark):
    empty = cluster(spark.createDataFrame([], VECTORS))
    assert empty.collect() == [] and empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert cluster(spark.createDataFrame([(None, [1.0, 1.0], 1)], VECTORS), size=2).collect() == []
