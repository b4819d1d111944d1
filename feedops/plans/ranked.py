"""Positions and running totals in a total order, without a one-task window.

Rows are range-partitioned and written once (see ``session.durable``); every
later step works inside one range partition, and only the totals per partition
are added up globally.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedops.plans.columns import col
from feedops.session import durable

# Value ranges a sort column is cut into when rows are looked up by position.
GRID = 200
# Texts of a sort column looked at when rows are looked up by position.
SAMPLED = 10_000


def ranges(df: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """``df`` cut into ranges of the order and written, with the range number ``__part``."""
    ordered = df.repartitionByRange(*[col(c) for c in order_by])
    return durable(ordered.withColumn("__part", F.spark_partition_id()))


def range_totals(ranged: DataFrame, amount: str, within: Sequence[str] = ()) -> DataFrame:
    """``within, __part, __start, __sum``: the total of each range partition and of
    all before it in the same group.

    At most (partitions + groups) rows, as a group covers consecutive partitions.
    """
    group = list(within)
    parts = ranged.groupBy(*[col(g) for g in group], "__part").agg(F.sum(amount).alias("__sum"))
    before = Window.partitionBy(*[col(g) for g in group]).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("__start", F.coalesce(F.sum("__sum").over(before), F.lit(0)))


def running_inside(ranged: DataFrame, order_by: Sequence[str], amount: str, out: str, within: Sequence[str] = ()) -> DataFrame:
    """Adds the running total inside each range partition of each group."""
    inside = (
        Window.partitionBy(*[col(g) for g in within], "__part").orderBy(*[col(c) for c in order_by])
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return ranged.withColumn(out, F.sum(amount).over(inside))


def running_total(
    df: DataFrame, order_by: Sequence[str], amount: str, out: str, within: Sequence[str] = ()
) -> DataFrame:
    """Adds ``out``: the sum of ``amount`` over all earlier rows and this one.

    ``within`` restarts the total per group. A group that spans many range
    partitions is summed partition by partition, so a hot group stays spread.
    ``order_by`` must be a total order inside each group.
    """
    group = list(within)
    ranged = ranges(df, group + list(order_by))
    keys = [*group, "__part"]
    starts = range_totals(ranged, amount, group).select(*[col(g).alias(f"__g{i}") for i, g in enumerate(keys)], "__start")
    local = running_inside(ranged, order_by, amount, "__local", group)
    # a group without a name is a group too
    joined = local.join(starts, reduce(Column.__and__, [col(g).eqNullSafe(F.col(f"__g{i}")) for i, g in enumerate(keys)]))
    return joined.select(*[col(c) for c in df.columns if c != out], (F.col("__start") + F.col("__local")).alias(out))


def numbered(df: DataFrame, order_by: Sequence[str], out: str, within: Sequence[str] = ()) -> DataFrame:
    """Adds ``out``: the 1-based position of each row, per group if ``within``."""
    counted = running_total(df.withColumn("__one", F.lit(1).cast("bigint")), order_by, "__one", out, within)
    return counted.drop("__one")


def nth_values(df: DataFrame, n: int, order_by: Sequence[str], within: str) -> DataFrame:
    """``__group, __value, __room, __ties`` of each group of ``n`` rows or more: the order value of its ``n``-th row as a
    struct, how many of the rows with that value are among the first ``n``, and how many rows have it.

    Only the group and the order columns are shuffled, and counted before: equal ones are one row. A range holds no group
    or value whole unless it is small, so a hot group stays spread.
    """
    value = F.struct(*[col(c).alias(f"o{i}") for i, c in enumerate(order_by)])
    counted = df.select(col(within).alias("__group"), value.alias("__value")).groupBy("__group", "__value").agg(F.count("*").alias("__ties"))
    ranged = ranges(counted, ["__group", "__value"])
    starts = range_totals(ranged, "__ties", ["__group"]).filter((F.col("__start") < n) & (F.col("__start") + F.col("__sum") >= n))
    starts = starts.select(F.col("__group").alias("__g"), F.col("__part").alias("__p"), "__start")
    inside = ranged.join(starts, F.col("__group").eqNullSafe(F.col("__g")) & (F.col("__part") == F.col("__p")))
    upto = running_inside(inside, ["__value"], "__ties", "__upto", ["__group"]).withColumn("__upto", F.col("__start") + F.col("__upto"))
    room = F.lit(n) - (F.col("__upto") - F.col("__ties"))
    return upto.filter((F.col("__upto") >= n) & (room > 0)).select("__group", "__value", room.alias("__room"), "__ties")


def _rows_at(keys: DataFrame, order_by: Sequence[str], positions: Sequence[int], enough: int) -> list[tuple | None]:
    """Order values of the rows at 0-based positions, None beyond the end.

    A range partition that holds a position is sorted in a task if it is small
    enough, else it is cut into ranges again. The driver sees one count per
    partition and one row per position.
    """
    ranged = ranges(keys, order_by)
    sizes = sorted((r["__part"], r["n"]) for r in ranged.groupBy("__part").agg(F.count("*").alias("n")).collect())
    total = sum(n for _, n in sizes)
    out: list[tuple | None] = []
    for position in positions:
        if position >= total:
            out.append(None)
            continue
        for part, n in sizes:
            if position < n:
                break
            position -= n
        inside = ranged.filter(F.col("__part") == part).drop("__part")
        if n <= enough or n == total:
            row = inside.orderBy(*[col(c) for c in order_by]).offset(position).limit(1).collect()[0]
            out.append(tuple(row[c] for c in order_by))
        else:
            out += _rows_at(inside, order_by, [position], enough)
    return out


def _around(df: DataFrame, name: str, n: int, start: int, end: int) -> tuple | None:
    """Two values of a column that should enclose the non-null rows ``start`` to
    ``end``: from a quantile sketch, or for texts from a sample of bounded size."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        steps = [i / GRID for i in range(GRID + 1)]
        values = df.agg(F.percentile_approx(col(name), steps, 10000).alias("q")).collect()[0]["q"]
        margin = 1
    elif isinstance(kind, T.StringType):
        rows = df.select(col(name)).filter(col(name).isNotNull())
        drawn = rows.sample(fraction=min(1.0, SAMPLED / n), seed=n).orderBy(col(name)).collect()
        values = [r[0] for r in drawn]
        margin = 2 * math.isqrt(len(values)) + 1
    else:
        return None
    if not values:
        return None
    last = len(values) - 1
    low, high = math.floor(start * last / n) - margin, math.ceil(end * last / n) + margin
    return values[max(0, low)], values[min(last, high)]


def _narrowed(df: DataFrame, order_by: Sequence[str], start: int, count: int) -> tuple[DataFrame, int]:
    """A part of ``df`` that holds the wanted rows, and the rows before that part.

    Estimated bounds on the first order column give a value range; one pass
    counts the rows below and inside it exactly. A range of a single value (a hot
    one, say) is narrowed by the next column. Where nothing fits the whole table
    is returned.
    """
    first = col(order_by[0])
    size = df.agg(F.count(first).alias("n"), F.count_if(first.isNull()).alias("nulls")).collect()[0]
    n, nulls = size["n"], size["nulls"]
    end = min(start + count, n + nulls)
    if start < nulls or start >= end:
        return df, 0
    found = _around(df, order_by[0], n, start - nulls, end - nulls)
    if found is None:
        return df, 0
    low, high = (F.lit(v) for v in found)
    exact = df.agg(
        F.count_if(first.isNull() | (first < low)).alias("below"), F.count_if((first >= low) & (first <= high)).alias("inside")
    ).collect()[0]
    below = exact["below"]
    if not below <= start < end <= below + exact["inside"]:
        return df, 0
    part = df.filter((first >= low) & (first <= high))
    if found[0] == found[1] and len(order_by) > 1:
        part, more = _narrowed(part, order_by[1:], start - below, count)
        return part, below + more
    return part, below


def range_bounds(
    df: DataFrame, order_by: Sequence[str], start: int, count: int, enough: int = 1_000_000
) -> tuple[tuple, tuple | None] | None:
    """Order values of the rows at ``start`` and ``start + count - 1``.

    The second is None where the table ends before it. Only the order columns of
    the part around the range are shuffled.
    """
    if count <= 0:
        return None
    keys, before = _narrowed(df.select(*[col(c) for c in order_by]), order_by, start, count)
    low, high = _rows_at(keys, order_by, [start - before, start - before + count - 1], enough)
    return None if low is None else (low, high)


def before(order_by: Sequence[str], low: tuple) -> Column:
    """Rows of an order that stand before ``low``."""
    here = F.struct(*[col(c).alias(c) for c in order_by])
    test = here < F.struct(*[F.lit(v).alias(c) for v, c in zip(low, order_by)])
    first = col(order_by[0])
    return test if low[0] is None else (first.isNull() | (first <= F.lit(low[0]))) & test


def between(order_by: Sequence[str], low: tuple, high: tuple | None) -> Column:
    """Rows of a total order from ``low`` to ``high``, both included.

    The test on the first column reaches the file scan; the tuple test is exact.
    """
    def values(bound: tuple) -> Column:
        return F.struct(*[F.lit(v).alias(c) for v, c in zip(bound, order_by)])

    here = F.struct(*[col(c).alias(c) for c in order_by])
    first = col(order_by[0])
    test = here >= values(low)
    if low[0] is not None:
        test = (first >= F.lit(low[0])) & test
    if high is not None:
        test = test & (here <= values(high))
        if high[0] is not None and low[0] is not None:
            test = (first <= F.lit(high[0])) & test
    return test
