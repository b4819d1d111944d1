"""One row per key, chosen by an order.

Ranking with a cut-off at 1 is planned by Spark as two group limits: each map
task sorts its rows and sends one row per key, then the reducers rank those. A
key that holds a third of the table is one row per task after the first step.
The result is partitioned and sorted by key, which a following join reuses.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedops.functions.fingerprints import fingerprint
from feedops.plans.columns import col

Order = Sequence[str | Column]
# Order for callers who know that no key is repeated.
UNIQUE: Order = ()
# Order for callers to whom any fixed choice among the rows of a key will do: the
# row with the largest fingerprint counts, and only that travels as its order.
BY_PRINT: Order = ("fingerprint of all columns but the key",)


def order_columns(order: Order) -> list[Column]:
    return [col(o) if isinstance(o, str) else o for o in order]


def order_struct(order: Order) -> Column:
    """The order columns as one comparable value."""
    return F.struct(*[p.alias(f"o{i}") for i, p in enumerate(order_columns(order))])


def valid_keys(df: DataFrame, key: str) -> DataFrame:
    """Rows whose key is neither NULL nor empty text."""
    text = dict(df.dtypes)[key] == "string"
    keep = col(key).isNotNull()
    return df.filter(keep & (col(key) != "") if text else keep)


def newest_row(df: DataFrame, key: str, order: Order) -> DataFrame:
    """The last row of every valid key in ``order``, columns as they are."""
    last = Window.partitionBy(col(key)).orderBy(*[c.desc() for c in order_columns(order)])
    return valid_keys(df, key).withColumn("__n", F.row_number().over(last)).filter(F.col("__n") == 1).drop("__n")


def last_per_key(df: DataFrame, key: str, order: Order, columns: Sequence[str] | None = None) -> DataFrame:
    """The last row of every key in ``order``; the key becomes text.

    Only ``columns`` (default: all) and the order travel through the shuffle.
    """
    names = list(columns) if columns is not None else df.columns
    rows = newest_row(df, key, order)
    return rows.select(*[col(c).cast("string").alias(c) if c == key else col(c) for c in names])


def whole_row(df: DataFrame, key: str) -> list[Column]:
    """All columns but the key, as an order in which the largest row is the last."""
    maps = {f.name for f in df.schema if isinstance(f.dataType, T.MapType)}
    return [F.to_json(col(c)) if c in maps else col(c) for c in df.columns if c != key] or [F.lit(0)]


def row_print(df: DataFrame, key: str) -> Column:
    """Fingerprint of all columns but the key; rows with the same one are equal as text."""
    return fingerprint([c for c in df.columns if c != key])


def one_per_key(df: DataFrame, key: str, order: Order | None) -> DataFrame:
    """The last row of every key in ``order``; None: the largest row; ``BY_PRINT``: the
    row with the largest fingerprint; ``UNIQUE``: only the key clean-up."""
    if order is None:
        return newest_row(df, key, whole_row(df, key))
    if order is BY_PRINT:
        return newest_row(df, key, [row_print(df, key)])
    return newest_row(df, key, order) if len(order) else valid_keys(df, key)
