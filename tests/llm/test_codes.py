import hashlib
import math
from collections import Counter

import numpy as np
import pytest

from feedops.llm import codes as op
from feedops.llm.centroids import MOST

VECTORS = "vec_id long, embedding array<double>, label string"


def plain(rows, parts, k, scale, rounds):
    """Every part compared with every entry."""
    kept = [(i, label, [max(-MOST, min(MOST, math.floor(scale * v))) for v in x]) for i, x, label in rows
            if x is not None and all(v is not None and math.isfinite(v) for v in x)]
    lengths = Counter(len(x) for _, _, x in kept if x and len(x) % parts == 0)
    dim = max(lengths, key=lambda n: (lengths[n], -n)) if lengths else None
    fit = [r for r in kept if len(r[2]) == dim]
    width = (dim or 0) // parts
    cut = lambda x: [tuple(x[p * width:(p + 1) * width]) for p in range(parts)]
    first = sorted(((i, x) for i, _, x in fit if i is not None))[:k]
    books = [[cut(x)[p] for _, x in first] for p in range(parts)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), n) for n, e in enumerate(book))

    for _ in range(rounds if first else 0):
        for p in range(parts):
            members = {}
            for _, _, x in fit:
                members.setdefault(nearest(cut(x)[p], books[p])[1], []).append(cut(x)[p])
            books[p] = [tuple(sum(v) // len(members[n]) for v in zip(*members[n])) if n in members else e for n, e in enumerate(books[p])]
    out, by_label = [], Counter()
    for i, label, x in kept:
        if len(x) != dim or not first:
            out.append((i, label, None, None))
            continue
        found = [nearest(part, book) for part, book in zip(cut(x), books)]
        error = sum(d for d, _ in found)
        by_label[label] += error
        out.append((i, label, "".join(f"{n:02x}" for _, n in found), error))
    known = {r[1] for r in out if r[3] is not None}
    digest = hashlib.sha256(",".join(str(v) for book in books for e in book for v in e).encode()).hexdigest()
    return order([(i, code, error, by_label[label] if label in known else None, digest) for i, label, code, error in out])


def order(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((v is not None, v) for v in r))


@pytest.mark.parametrize("seed", range(8))
def test_ball_rounds_equal_full_search(seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(-9, 10, (400, 3)) if seed % 2 else np.round(rng.normal(0, 30, (400, 3)) + 100 * rng.integers(0, 5, (400, 1))).astype(np.int64)
    entries = x[:12].copy()
    entries[7] = entries[3]
    own, radius, moved, spent = np.zeros(400, np.int64), np.full(12, op.UNKNOWN), np.ones(12, bool), []
    for _ in range(9):
        own, radius, work = op.ball_round(x, own, radius, entries, moved)
        exact = ((x[:, None] - entries[None]) ** 2).sum(2)
        assert np.array_equal(own, exact.argmin(1))
        for g in np.unique(own):
            assert radius[g] >= exact[own == g, g].max()
        spent.append(work)
        after = np.array([x[own == g].sum(0) // max(1, (own == g).sum()) if (own == g).any() else entries[g] for g in range(12)])
        moved, entries = (after != entries).any(1), after
    assert spent[-1] < 400 * 12 / 2


def test_unmoved_balls_cost_nothing():
    x = np.array([[0], [1], [100], [101]])
    own, radius, _ = op.ball_round(x, np.zeros(4, np.int64), np.full(2, op.UNKNOWN), np.array([[0], [100]]), np.ones(2, bool))
    again, _, work = op.ball_round(x, own, radius, np.array([[0], [100]]), np.zeros(2, bool))
    assert work == 0 and np.array_equal(again, [0, 0, 1, 1])


def test_codes_equal_plain(spark, monkeypatch):
    monkeypatch.setattr(op, "BLOCK", 64)
    rng = np.random.default_rng(1)
    rows = [(i, [float(v) for v in rng.normal(0, 1, 8)], str(i % 3)) for i in range(400)]
    rows += rows[:30] + [(1000 + i, rows[9][1], None) for i in range(200)]
    found = op.codes(spark.createDataFrame(rows, VECTORS).repartition(6), parts=4, k=9, rounds=5)
    assert order(found.collect()) == plain(rows, 4, 9, 4096, 5)


def test_odd_rows(spark):
    x = [[1.0, 2.0], [1.0, 2.0], [-3.5, 0.1], None, [], [1.0], [1.0, None], [1.0, float("nan")], [float("-inf"), 1.0], [1e300, -1e300], [0.0, 0.0], [1.0, 2.0, 3.0, 4.0]]
    rows = [(i if i != 10 else None, v, "a" if i % 2 else None) for i, v in enumerate(x)]
    rows += [rows[0], (2, [7.0, 7.0], "only")]
    df = spark.createDataFrame([(*r, "z", 1, 2) for r in rows], VECTORS + ", code string, block int, x int")
    assert order(op.codes(df, parts=2, k=3).collect()) == plain(rows, 2, 3, 4096, 6)


def test_no_rows(spark):
    empty = op.codes(spark.createDataFrame([], VECTORS))
    assert empty.collect() == [] and empty.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    short = op.codes(spark.createDataFrame([(1, [1.0, 2.0], "a")], VECTORS)).collect()
    assert [tuple(r)[:4] for r in short] == [(1, None, None, None)]
