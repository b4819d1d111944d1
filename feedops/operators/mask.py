"""Obfuscation of columns."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedops.functions.masking import hashed, masked, scrambled
from feedops.plans.columns import col

METHODS = ("hash", "random", "mask")


def obfuscate(
    df: DataFrame, columns: Sequence[str], method: str = "hash", seed: int = 0, max_rows: int | None = None
) -> DataFrame:
    """``df`` with the columns replaced; all other columns as they are.

    ``hash``: SHA-256. ``random``: letters and digits of the same length, from
    the whole row and the seed. ``mask``: first and last character stay. An
    unknown method is reported and becomes ``hash``. ``max_rows`` keeps that
    many rows.
    """
    unknown = [c for c in columns if c not in df.columns]
    if unknown:
        raise ValueError(f"no such columns to mask: {', '.join(unknown)}")
    if method not in METHODS:
        warnings.warn(f"method {method!r} is not known; hashing instead", stacklevel=2)
        method = "hash"
    rows = df if max_rows is None else df.limit(max_rows)
    salt = F.xxhash64(F.lit(seed), *[col(c) for c in df.columns])
    out = []
    for i, name in enumerate(df.columns):
        value = col(name).cast("string")
        if name not in columns:
            out.append(col(name))
        elif method == "random":
            out.append(scrambled(value, F.xxhash64(salt, F.lit(i))).alias(name))
        else:
            out.append((hashed(value) if method == "hash" else masked(value)).alias(name))
    return rows.select(*out)
