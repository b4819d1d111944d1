"""Column lists: checks, look-ups and the default ignore list."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bookkeeping columns that never count as a difference.
DEFAULT_IGNORE = ["ROWNUMBER", "FILEDATE"]


def col(name: str) -> Column:
    """Column by its exact name, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def require_columns(df: DataFrame, names: Iterable[str]) -> list[str]:
    """The names, or an error that lists the unknown ones."""
    names = list(names)
    known = set(df.columns)
    unknown = [n for n in names if n not in known]
    if unknown:
        raise ValueError(f"unknown columns: {unknown}")
    return names


def resolve_key(df: DataFrame, name: str) -> str:
    """The column called ``name`` in any letter case, or an error."""
    if name in df.columns:
        return name
    for candidate in df.columns:
        if candidate.lower() == name.lower():
            return candidate
    raise ValueError(f"no column {name} among {df.columns}")


def without(names: Sequence[str], dropped: Iterable[str]) -> list[str]:
    """Names left after dropping some, compared in any letter case."""
    gone = {d.lower() for d in dropped}
    return [n for n in names if n.lower() not in gone]


def compared_columns(
    prev: DataFrame,
    curr: DataFrame,
    key: str,
    columns: Sequence[str] | None = None,
    ignore: Sequence[str] = (),
) -> list[str]:
    """Columns a diff looks at: the listed ones, or all shared ones less the
    key and the ignored ones, in the order of the current snapshot."""
    if columns is not None:
        return [c for c in columns if c in prev.columns and c in curr.columns]
    shared = [c for c in curr.columns if c in set(prev.columns)]
    skipped = {key, *DEFAULT_IGNORE, *ignore}
    return [c for c in shared if c not in skipped]


def header_difference(prev: DataFrame, curr: DataFrame) -> tuple[list[str], list[str]]:
    """(added, removed) column names from the previous to the current snapshot."""
    return (
        [c for c in curr.columns if c not in set(prev.columns)],
        [c for c in prev.columns if c not in set(curr.columns)],
    )


def check_same_header(prev: DataFrame, curr: DataFrame) -> None:
    """Error unless both snapshots have the same columns in the same order."""
    if prev.columns != curr.columns:
        added, removed = header_difference(prev, curr)
        raise ValueError(f"headers differ (added {added}, removed {removed})")
