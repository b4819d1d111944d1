import numpy as np
import pytest
from helpers import groups

from feedops.llm import common, vectors


def sample(seed=4, dim=24):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(150, dim))
    near = [v + rng.normal(size=dim) * s for v in base[:20] for s in (0.02, 0.1, 0.2, 0.3)]
    dense = [base[30] + rng.normal(size=dim) * 0.1 for _ in range(60)]
    return [list(map(float, np.float32(v))) for v in [*base, *near, *dense, *base[:15], *(3 * base[40:45])]]


def plain(rows, limit=0.9):
    unit = []
    for v in rows:
        ok = v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
        unit.append(np.array(v, float) / np.linalg.norm(v) if ok else None)
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= limit]
    links = [0] * len(rows)
    for i, j in pairs:
        links[i] += 1
        links[j] += 1
    roots = groups(len(rows), pairs)
    return [(i, links[i], roots[i], roots[i] == i) for i in range(len(rows))]


@pytest.mark.parametrize("kind", ["float", "double"])
@pytest.mark.parametrize("cap", [4096, 10])
def test_equals_brute_force(spark, monkeypatch, kind, cap):
    monkeypatch.setattr(common.split_hot, "__defaults__", (cap,))
    rows = sample()
    frame = spark.createDataFrame([(i, v, 1) for i, v in enumerate(rows)], f"vec_id long, embedding array<{kind}>, kept int").repartition(3)
    got = sorted(tuple(r) for r in vectors.near_copies(frame, recall=0.9999).collect())
    assert got == plain(rows)


def test_recall_at_the_planned_size(spark, monkeypatch):
    """With cells as small as for many vectors, pairs just above the limit are found as often as promised."""
    monkeypatch.setattr(vectors, "CELL_ROWS", 4)
    rng = np.random.default_rng(9)
    a = rng.normal(size=(600, 32))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=(600, 32))
    b -= (b * a).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    c = rng.uniform(0.9, 0.95, (600, 1))
    rows = [list(map(float, v)) for v in np.concatenate([a, c * a + np.sqrt(1 - c**2) * b])]
    width, tables, _ = vectors.plan(1200, 0.9, 0.97)
    assert width > 3 and tables > 3
    frame = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>")
    found = sum(r.n_links for r in vectors.near_copies(frame, recall=0.97).collect())
    assert found >= 0.95 * sum(r[1] for r in plain(rows))


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [None, [], [0.0, 0.0], [1.0, None], [1.0, nan], [inf, 1.0], [1.0, 0.0], [2.0, 0.0], [1.0, 0.0], [1.0, 0.0, 0.0], [1e-30, 0.0], [-1.0, 0.0], [1.0, -0.0]]
    frame = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in vectors.near_copies(frame).collect())
    assert got == plain(rows)
    assert vectors.near_copies(frame.limit(0)).collect() == []
    unnamed = spark.createDataFrame([(None, [1.0, 0.0]), (4, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert sorted(map(str, vectors.near_copies(unnamed).collect())) == sorted(
        ["Row(vec_id=None, n_links=0, component_id=None, kept=False)", "Row(vec_id=4, n_links=0, component_id=4, kept=True)"]
    )
