"""Newest value of every column per key, with the order of a row moved once and not once per column.

Each task sorts its rows by key, newest first, and walks them batch by batch: a cell survives if it is the first value of its
column in the key's run, a row if it has such a cell or is the first of its run. At most ``columns + 1`` rows per key and task
are left, so a key with a third of all rows is a handful of rows per task; they meet in one shuffle by key.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedops.plans.columns import col


def _runs(table: pa.Table, keys: Sequence[int]) -> np.ndarray:
    """Where runs of equal keys begin; equal nulls are one key."""
    n = table.num_rows
    new = np.zeros(n, bool)
    new[:1] = True
    for k in keys:
        here, before = table.column(k).slice(1), table.column(k).slice(0, n - 1)
        differ = pc.fill_null(pc.not_equal(here, before), True).to_numpy()
        both = pc.and_(pc.is_null(here), pc.is_null(before)).to_numpy()
        new[1:] |= differ & ~both
    return np.flatnonzero(new)


def _folded(table: pa.Table, keys: Sequence[int], columns: Sequence[int]) -> tuple[pa.Table, int]:
    """The surviving rows of a sorted table, and how many of them come before the last run."""
    n = table.num_rows
    starts = _runs(table, keys)
    kept, at = np.zeros(n, bool), np.arange(n)
    kept[starts] = True
    own = {}
    for c in columns:
        first = np.minimum.reduceat(np.where(table.column(c).is_valid().to_numpy(), at, n), starts)
        own[c] = first[first < n]
        kept[own[c]] = True
    rows = np.flatnonzero(kept)
    made = []
    for c in range(table.num_columns):
        if c in own:
            gone = np.ones(n, bool)
            gone[own[c]] = False
            made.append(table.column(c).take(pa.array(rows, mask=gone[rows])))
        else:
            made.append(table.column(c).take(pa.array(rows)))
    return pa.Table.from_arrays(made, schema=table.schema), int(np.searchsorted(rows, starts[-1]))


def _pruned(keys: Sequence[int], columns: Sequence[int]):
    """Task over sorted rows; the last run of a batch is held until its end is known."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            table, whole = _folded(pa.Table.from_batches([*held, batch]).combine_chunks(), keys, columns)
            yield from table.slice(0, whole).to_batches()
            held = table.slice(whole).combine_chunks().to_batches()
        yield from held

    return run


def newest_cells(rows: DataFrame, keys: Sequence[str], columns: Sequence[str], order: str) -> DataFrame:
    """The rows of ``rows`` that hold the newest value of a column of their key, other cells of ``columns`` NULL, dealt by key.

    ``order`` is one column, the larger the newer. A following ``groupBy(keys)`` needs no further shuffle.
    """
    place = {name: i for i, name in enumerate(rows.columns)}
    ordered = rows.sortWithinPartitions(*[col(k) for k in keys], col(order).desc())
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in rows.schema])
    pruned = ordered.mapInArrow(_pruned([place[k] for k in keys], [place[c] for c in columns]), schema)
    return pruned.repartition(*[col(k) for k in keys])


def newest_of(column: str, order: str) -> Column:
    """Aggregate: the value of ``column`` in the row with the largest ``order`` that has one."""
    return F.max_by(col(column), F.when(col(column).isNotNull(), col(order)))
