"""One value that changes when any compared column of a row changes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fingerprint(columns: list[str]) -> Column:
    """md5 of the columns, in name order.

    Each cell goes in with its length in front, NULL as a dash, so no two rows
    share a text and an empty cell differs from a missing one.
    """
    parts = []
    for name in sorted(columns):
        text = F.col("`" + name.replace("`", "``") + "`").cast("string")
        parts.append(F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.md5(F.concat(*parts) if parts else F.lit(""))
