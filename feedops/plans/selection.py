"""Exact values at given ranks, by narrowing value ranges: no sort, no shuffle of rows.

Each round cuts the range a rank lies in with quantiles of a random sample and
then counts all rows between the cuts, and on them, exactly. A rank on a cut is
answered (so a value that holds much of the column ends the search), else the
range shrinks to what lies strictly between two cuts, about a fiftieth of it. The
sample only steers the cuts: a bad one costs another round, not a wrong answer.
Once few rows are left they are sorted in one aggregate.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedops.plans.columns import col

GRID = 200
# Rows of the sample that steers the cuts.
SAMPLED = 50_000
# Most rows of one range that are sorted in a single aggregate.
ENOUGH = 100_000


@dataclass
class _Search:
    """One rank of one column and the open value range it lies in."""

    column: str
    rank: int
    inside: int
    below: int = 0
    low: float | None = None
    high: float | None = None
    value: float | None = None

    @property
    def range(self) -> tuple[str, float | None, float | None]:
        return self.column, self.low, self.high


def _within(column: str, low: float | None, high: float | None) -> Column:
    c = col(column)
    test = c.isNotNull()
    if low is not None:
        test = test & (c > F.lit(low))
    if high is not None:
        test = test & (c < F.lit(high))
    return test


def _any(ranges: Sequence[tuple]) -> Column:
    """Rows of any range; the test reaches the scan."""
    return reduce(lambda a, b: a | b, [_within(*r) for r in ranges])


def _cuts(df: DataFrame, open_: list[_Search], rounds: int) -> list[tuple[float, float]]:
    """Two values around each rank, from a sample of its range."""
    ranges = list(dict.fromkeys(s.range for s in open_))
    share = min(1.0, SAMPLED / min(s.inside for s in open_))
    steps = [i / GRID for i in range(GRID + 1)]
    rows = df.filter(_any(ranges))
    rows = rows.sample(fraction=share, seed=rounds) if share < 1 else rows
    grids = rows.agg(*[
        F.percentile_approx(F.when(_within(*r), col(r[0])), steps, 10_000).alias(f"g{i}") for i, r in enumerate(ranges)
    ]).collect()[0]
    out = []
    for s in open_:
        grid = grids[f"g{ranges.index(s.range)}"]
        if not grid:  # nothing of this range was drawn
            grid = [df.filter(_within(*s.range)).agg(F.percentile_approx(col(s.column), 0.5)).collect()[0][0]] * (GRID + 1)
        at = (s.rank - s.below) * GRID / s.inside
        out.append((grid[max(0, math.floor(at) - 1)], grid[min(GRID, math.ceil(at) + 1)]))
    return out


def _counted(df: DataFrame, open_: list[_Search], cuts: Mapping[str, list[float]]) -> dict[tuple[str, int], int]:
    """Rows per column and bucket: bucket 2j lies under cut j, bucket 2j+1 is cut j."""
    ranges = list(dict.fromkeys(s.range for s in open_))
    buckets = []
    for column, values in cuts.items():
        c, bucket = col(column), F
        for j, v in enumerate(values):
            bucket = bucket.when(c < F.lit(v), 2 * j).when(c == F.lit(v), 2 * j + 1)
        mine = _any([r for r in ranges if r[0] == column])
        buckets.append(F.when(mine, bucket.otherwise(2 * len(values))).alias(column))
    long = df.filter(_any(ranges)).select(*buckets).unpivot([], list(cuts), "column", "bucket")
    counts = long.filter(F.col("bucket").isNotNull()).groupBy("column", "bucket").agg(F.count("*").alias("n"))
    return {(r["column"], r["bucket"]): r["n"] for r in counts.collect()}


def _narrow(df: DataFrame, open_: list[_Search], rounds: int) -> None:
    edges = _cuts(df, open_, rounds)
    cuts: dict[str, list[float]] = {}
    for column in dict.fromkeys(s.column for s in open_):
        used = {v for s, pair in zip(open_, edges) if s.column == column for v in (*pair, s.low, s.high)}
        cuts[column] = sorted(v for v in used if v is not None)
    n = _counted(df, open_, cuts)
    for s, (low, high) in zip(open_, edges):
        values = cuts[s.column]
        first = 0 if s.low is None else 2 * bisect_left(values, s.low) + 2
        last = 2 * len(values) if s.high is None else 2 * bisect_left(values, s.high)
        at_low, at_high = 2 * bisect_left(values, low) + 1, 2 * bisect_left(values, high) + 1
        total = lambda a, b: sum(n.get((s.column, k), 0) for k in range(a, b))  # noqa: B023, E731
        before_low = s.below + total(first, at_low)
        before_high = s.below + total(first, at_high)
        if s.rank < before_low:
            s.inside, s.high = before_low - s.below, low
        elif s.rank < before_low + total(at_low, at_low + 1):
            s.value = low
        elif s.rank < before_high:
            s.below = before_low + total(at_low, at_low + 1)
            s.inside, s.low, s.high = before_high - s.below, low, high
        elif s.rank < before_high + total(at_high, at_high + 1):
            s.value = high
        else:
            s.below, s.low = before_high + total(at_high, at_high + 1), high
            s.inside = total(at_high + 1, last + 1)


def values_at(df: DataFrame, ranks: Mapping[str, Sequence[int]], sizes: Mapping[str, int]) -> dict[tuple[str, int], float]:
    """``{(column, rank): value}`` for 0-based ranks of double columns without NaN.

    ``sizes`` holds the number of non-null values per column. Runs two passes
    per round and one at the end, over the needed columns only; the driver sees
    sample quantiles, counts and the answers.
    """
    searches = [_Search(c, r, sizes[c]) for c, wanted in ranks.items() for r in sorted(set(wanted)) if sizes[c]]
    rounds = 0
    while open_ := [s for s in searches if s.value is None and s.inside > ENOUGH]:
        _narrow(df, open_, rounds)
        rounds += 1
    if last := [s for s in searches if s.value is None]:
        ranges = list(dict.fromkeys(s.range for s in last))
        at = {r: i for i, r in enumerate(ranges)}
        lists = [F.sort_array(F.collect_list(F.when(_within(*r), col(r[0])))).alias(f"v{i}") for i, r in enumerate(ranges)]
        kept = df.filter(_any(ranges)).agg(*lists)
        picks = [F.get(f"v{at[s.range]}", F.lit(s.rank - s.below)).alias(f"s{k}") for k, s in enumerate(last)]
        picked = kept.select(*picks).collect()[0]
        for k, s in enumerate(last):
            s.value = picked[f"s{k}"]
    return {(s.column, s.rank): s.value for s in searches}
