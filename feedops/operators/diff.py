"""Differences between two snapshots of a keyed table.

All operators work on the pair ``(prev, curr)``. Each side is reduced to one row
per key (map-side first) and both sides meet in one join on the key. The
reduction leaves the rows partitioned and sorted by key, so the join adds no
shuffle, and since keys are unique then, no key is hot.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedops.functions.fingerprints import fingerprint
from feedops.plans.columns import DEFAULT_IGNORE, check_same_header, col, compared_columns
from feedops.plans.keyed import BY_PRINT, UNIQUE, Order, last_per_key, one_per_key, row_print

__all__ = [
    "ALTERNATIVE_IDS", "BY_PRINT", "DEFAULT_IGNORE", "UNIQUE", "annotate_changes", "annotated_delta", "cell_changes", "change_documents", "changed_columns",
    "classify", "delta_rows", "diff_stats", "last_per_key", "match_ids", "split_changes",
]

# Identifier columns tried in this order when a change log is matched to rows.
ALTERNATIVE_IDS = ["ID_BB_GLOBAL", "ID_BB_SECURITY", "ID_BB_YELLOWKEY", "ID_BB_UNIQUE"]

# Identifiers that are looked up by a broadcast take at most so many bytes.
SOUGHT_BYTES = 64_000_000


def _prepared(
    prev: DataFrame, curr: DataFrame, key: str, columns: Sequence[str] | None, ignore: Sequence[str],
    require_same_header: bool,
) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides with one key type, and the compared columns."""
    if require_same_header:
        check_same_header(prev, curr)
    for side in (prev, curr):
        if key not in side.columns:
            raise ValueError(f"no key column {key} among {side.columns}")
    compared = compared_columns(prev, curr, key, columns, ignore)
    if dict(prev.dtypes)[key] != dict(curr.dtypes)[key]:
        prev, curr = (s.withColumn(key, col(key).cast("string")) for s in (prev, curr))
    return prev, curr, compared


def _key(key: str, out: str | None = None) -> Column:
    return col(key).cast("string").alias(out or key)


def _side(df: DataFrame, key: str, order: Order | None, columns: Sequence[str], mark: str) -> DataFrame:
    """Key, a presence flag ``mark`` and the columns as ``mark`` plus position."""
    one = one_per_key(df, key, order)
    return one.select(col(key), F.lit(True).alias(mark), *[col(c).alias(f"{mark}{i}") for i, c in enumerate(columns)])


def _differs(prev: DataFrame, curr: DataFrame, compared: Sequence[str], nulls: str) -> list[Column]:
    """One test per compared column over the joined sides ``__p`` and ``__c``.

    Values compare as text; where both sides have one exact type that is the
    same as comparing the values.
    """
    if nulls not in ("ignore", "strict"):
        raise ValueError(f"unknown null policy {nulls!r}")
    before, after = dict(prev.dtypes), dict(curr.dtypes)
    exact = ("string", "bigint", "int", "smallint", "tinyint", "boolean", "date")
    tests = []
    for i, name in enumerate(compared):
        a, b = F.col(f"__p{i}"), F.col(f"__c{i}")
        if before[name] != after[name] or before[name] not in exact:
            a, b = a.cast("string"), b.cast("string")
        tests.append(~a.eqNullSafe(b) if nulls == "strict" else F.coalesce(a != b, F.lit(False)))
    return tests


def _any(tests: Sequence[Column]) -> Column:
    """OR of many tests as a balanced tree, which compiles for wide tables too."""
    if not tests:
        return F.lit(False)
    if len(tests) == 1:
        return tests[0]
    half = len(tests) // 2
    return _any(tests[:half]) | _any(tests[half:])


def classify(
    prev: DataFrame,
    curr: DataFrame,
    key: str,
    order: Order | None = None,
    columns: Sequence[str] | None = None,
    ignore: Sequence[str] = (),
    require_same_header: bool = False,
) -> DataFrame:
    """``key, status``: ``new``, ``modified``, ``deleted`` or ``unchanged``.

    Only the key, the order and a 32-character fingerprint of each row are
    shuffled. ``order`` decides which row of a repeated key counts, the last in
    it; None: the largest row, for which all columns have to travel; ``BY_PRINT``: the row with the largest fingerprint of its
    columns, which travels in their place; ``UNIQUE``: no key is repeated. ``columns`` limits the comparison; otherwise all but the
    ignored count.
    """
    prev, curr, compared = _prepared(prev, curr, key, columns, ignore, require_same_header)
    if order is BY_PRINT:
        # worked out at the scan, so that the shuffle takes the key and two texts of 32 characters
        prev, curr = (s.select(col(key), row_print(s, key).alias("__rank"), fingerprint(compared).alias("__print")) for s in (prev, curr))
        p, c = (_side(s, key, ["__rank"], ["__print"], mark) for s, mark in ((prev, "__p"), (curr, "__c")))
        return _statuses(p, c, key)
    p = _side(prev.withColumn("__print", fingerprint(compared)), key, order, ["__print"], "__p")
    c = _side(curr.withColumn("__print", fingerprint(compared)), key, order, ["__print"], "__c")
    return _statuses(p, c, key)


def _statuses(p: DataFrame, c: DataFrame, key: str) -> DataFrame:
    """Both sides, each with the fingerprint of its compared columns, as ``key, status``."""
    status = (
        F.when(F.col("__p").isNull(), "new").when(F.col("__c").isNull(), "deleted")
        .when(F.col("__p0") != F.col("__c0"), "modified").otherwise("unchanged")
    )
    return p.join(c, key, "full_outer").select(_key(key), status.alias("status"))


def split_changes(
    prev: DataFrame,
    curr: DataFrame,
    key: str,
    order: Order | None = None,
    keys_only: bool = False,
    columns: Sequence[str] | None = None,
    ignore: Sequence[str] = (),
) -> dict[str, DataFrame]:
    """Frames ``new``, ``modified`` (rows of ``curr``) and ``deleted`` (rows of
    ``prev``), or their keys only. ``all`` holds the three with ``status`` from
    the same single join: write it once, partitioned by ``status``."""
    if keys_only:
        every = classify(prev, curr, key, order, columns, ignore).filter(F.col("status") != "unchanged")
    else:
        old_side, now_side, compared = _prepared(prev, curr, key, columns, ignore, False)
        old = [c for c in prev.columns if c != key]
        now = [c for c in curr.columns if c != key]
        p = _side(old_side.withColumn("__print", fingerprint(compared)), key, order, [*old, "__print"], "__p")
        c = _side(now_side.withColumn("__print", fingerprint(compared)), key, order, [*now, "__print"], "__c")
        gone = F.col("__c").isNull()
        status = (
            F.when(F.col("__p").isNull(), "new").when(gone, "deleted")
            .when(F.col(f"__p{len(old)}") != F.col(f"__c{len(now)}"), "modified")
        )
        both = p.join(c, key, "full_outer").withColumn("status", status).filter(F.col("status").isNotNull())

        def value(name: str) -> Column:
            before = F.col(f"__p{old.index(name)}") if name in old else F.lit(None)
            after = F.col(f"__c{now.index(name)}") if name in now else F.lit(None)
            return F.when(gone, before).otherwise(after).alias(name)

        every = both.select(_key(key), *[value(n) for n in [*now, *[o for o in old if o not in now]]], "status")
    kept = {"new": curr, "modified": curr, "deleted": prev}
    out = {
        s: every.filter(F.col("status") == s).select(*[col(c) for c in ([key] if keys_only else side.columns)])
        for s, side in kept.items()
    }
    return {**out, "all": every}


def cell_changes(
    prev: DataFrame,
    curr: DataFrame,
    key: str,
    order: Order | None = None,
    ignore: Sequence[str] = (),
    nulls: str = "ignore",
    columns: Sequence[str] | None = None,
    require_same_header: bool = False,
) -> DataFrame:
    """``key, column, previous_value, current_value``, one row per changed cell.

    ``ignore``: a cell with NULL on either side is no change. ``strict``: any
    difference counts. Unchanged rows are dropped before cells are made.
    """
    prev, curr, compared = _prepared(prev, curr, key, columns, ignore, require_same_header)
    if not compared:
        raise ValueError("no columns to compare")
    p, c = _side(prev, key, order, compared, "__p"), _side(curr, key, order, compared, "__c")
    tests = _differs(prev, curr, compared, nulls)
    cells = [
        F.when(
            test,
            F.struct(
                F.lit(name).alias("column"),
                F.col(f"__p{i}").cast("string").alias("previous_value"),
                F.col(f"__c{i}").cast("string").alias("current_value"),
            ),
        )
        for i, (name, test) in enumerate(zip(compared, tests))
    ]
    changed = p.join(c, key).filter(_any(tests)).select(_key(key, "key"), F.explode(F.array(*cells)).alias("cell"))
    return changed.filter(F.col("cell").isNotNull()).select(
        "key", "cell.column", "cell.previous_value", "cell.current_value"
    )


def change_documents(cells: DataFrame) -> DataFrame:
    """``key, changes``: the changed cells of a key as one JSON object
    ``{column: {column, previous_value, current_value}}`` in column order.

    What is gathered per key is bounded by the number of columns.
    """
    entry = F.struct(
        F.col("column").alias("name"), F.struct("column", "previous_value", "current_value").alias("cell")
    )
    grouped = cells.groupBy("key").agg(F.array_sort(F.collect_list(entry)).alias("cells"))
    return grouped.select(
        "key", F.to_json(F.map_from_entries("cells"), {"ignoreNullFields": "false"}).alias("changes")
    )


def delta_rows(
    prev: DataFrame,
    curr: DataFrame,
    key: str,
    order: Order | None = None,
    ignore: Sequence[str] = (),
    nulls: str = "ignore",
) -> DataFrame:
    """Rows of ``curr`` that are new or changed, with ``curr``'s columns."""
    names = curr.columns
    prev, curr, compared = _prepared(prev, curr, key, None, ignore, False)
    rest = [c for c in names if c != key and c not in compared]
    now = _side(curr, key, order, [*compared, *rest], "__c")
    both = now.join(_side(prev, key, order, compared, "__p"), key, "left")
    kept = both.filter(F.col("__p").isNull() | _any(_differs(prev, curr, compared, nulls)))
    at = {c: f"__c{i}" for i, c in enumerate([*compared, *rest])}
    return kept.select(*[_key(key) if c == key else F.col(at[c]).alias(c) for c in names])


def diff_stats(
    prev: DataFrame,
    curr: DataFrame,
    key: str,
    order: Order | None = None,
    ignore: Sequence[str] = (),
    nulls: str = "ignore",
) -> DataFrame:
    """One row: ``current_row_count, delta_row_count, new_records,
    changed_records, removed_records, changed_columns`` (sorted).

    One join and one global aggregate; the changed columns come from one flag
    per column, so no cell rows are made.
    """
    prev, curr, compared = _prepared(prev, curr, key, None, ignore, False)
    both = _side(prev, key, order, compared, "__p").join(_side(curr, key, order, compared, "__c"), key, "full_outer")
    had, has = F.col("__p").isNotNull(), F.col("__c").isNotNull()
    tests = [
        (had & has & t).alias(f"__f{i}") for i, t in enumerate(_differs(prev, curr, compared, nulls))
    ]
    flags = [F.col(f"__f{i}") for i in range(len(tests))]
    counted = both.select("__p", "__c", *tests).agg(
        F.count("__c").alias("current_row_count"),
        F.count_if(has & ~had).alias("new_records"),
        F.count_if(_any(flags)).alias("changed_records"),
        F.count_if(had & ~has).alias("removed_records"),
        *[F.max(f).alias(f"__f{i}") for i, f in enumerate(flags)],
    )
    names = [F.when(F.col(f"__f{i}"), F.lit(c)) for i, c in enumerate(compared)]
    listed = F.array_sort(F.array_compact(F.array(*names))) if names else F.array().cast("array<string>")
    return counted.select(
        "current_row_count",
        (F.col("new_records") + F.col("changed_records")).alias("delta_row_count"),
        "new_records", "changed_records", "removed_records",
        listed.alias("changed_columns"),
    )


def changed_columns(cells: DataFrame) -> DataFrame:
    """Sorted names of the columns that changed anywhere."""
    return cells.select("column").distinct().orderBy("column")


def annotate_changes(delta: DataFrame, cells: DataFrame, key: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Delta rows with the key and the changed columns only, each column as
    ``struct(value, previous, changed)``; ``previous`` reads ``Previous: x``.

    ``columns`` names the changed columns; left out, they are looked up first
    (the driver sees column names only).
    """
    if columns is None:
        hit = {r[0] for r in cells.select("column").distinct().collect()}
        columns = [c for c in delta.columns if c in hit]
    grouped = cells.groupBy(F.col("key").alias("__key")).agg(
        F.map_from_entries(
            F.collect_list(F.struct("column", F.coalesce("previous_value", F.lit("")).alias("value")))
        ).alias("__before")
    )
    joined = delta.join(grouped, col(key).cast("string") == F.col("__key"), "left")

    def cell(c: str) -> Column:
        before = F.try_element_at(F.col("__before"), F.lit(c))
        return F.struct(
            col(c).cast("string").alias("value"),
            F.when(before.isNotNull(), F.concat(F.lit("Previous: "), before)).alias("previous"),
            before.isNotNull().alias("changed"),
        ).alias(c)

    return joined.select(col(key), *[cell(c) for c in columns if c != key])


def annotated_delta(
    prev: DataFrame,
    curr: DataFrame,
    key: str,
    order: Order | None = None,
    ignore: Sequence[str] = (),
    nulls: str = "ignore",
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """``annotate_changes`` of the delta of two snapshots, from the one join that finds it.

    ``columns`` names the changed columns; left out, one more pass over the join flags them (the driver sees one row of flags).
    """
    prev, curr, compared = _prepared(prev, curr, key, None, ignore, False)
    both = _side(curr, key, order, compared, "__c").join(_side(prev, key, order, compared, "__p"), key, "left")
    had = F.col("__p").isNotNull()
    tests = [had & t for t in _differs(prev, curr, compared, nulls)]
    if columns is None:
        flags = both.agg(F.count("*"), *[F.max(t) for t in tests]).collect()[0][1:]
        columns = [c for c in curr.columns if c in compared and flags[compared.index(c)]]

    def cell(c: str) -> Column:
        i = compared.index(c)
        before = F.when(tests[i], F.concat(F.lit("Previous: "), F.coalesce(F.col(f"__p{i}").cast("string"), F.lit(""))))
        return F.struct(F.col(f"__c{i}").cast("string").alias("value"), before.alias("previous"), tests[i].alias("changed")).alias(c)

    return both.filter(~had | _any(tests)).select(_key(key), *[cell(c) for c in columns if c in compared])


def _sought(keys: DataFrame, key: str) -> DataFrame:
    """Distinct identifiers, marked for broadcast if all of them together take no more than ``SOUGHT_BYTES``."""
    wanted = keys.select(col(key).cast("string").alias("id")).filter(F.col("id").isNotNull()).distinct()
    size = wanted.agg(F.coalesce(F.sum(F.octet_length("id") + 32), F.lit(0))).collect()[0][0]
    return F.broadcast(wanted) if size <= SOUGHT_BYTES else wanted


def match_ids(
    rows: DataFrame, keys: DataFrame, row_key: str, id_columns: Sequence[str] = ALTERNATIVE_IDS, key: str = "key"
) -> DataFrame:
    """``key, row_key, id_column``: rows a change-log key points to.

    The first identifier column in which a key occurs at all decides; later ones
    are not looked at. Rows are marked by their wanted identifiers first; where the
    keys are few enough to be broadcast, no other row is shuffled.
    """
    present = [c for c in id_columns if c in rows.columns]
    wanted = _sought(keys, key)
    # rows without a wanted identifier go before any cell is exploded
    marked = rows.select(col(row_key).alias("__row"), *[col(c).cast("string").alias(f"__i{i}") for i, c in enumerate(present)])
    for i in range(len(present)):
        marked = marked.join(wanted.select(F.col("id").alias(f"__w{i}")), F.col(f"__i{i}") == F.col(f"__w{i}"), "left")
    hits = [F.when(F.col(f"__w{i}").isNotNull(), F.struct(F.lit(i).alias("priority"), F.lit(c).alias("id_column"), F.col(f"__w{i}").alias("id"))) for i, c in enumerate(present)]
    if not hits:
        nothing = rows.select(F.lit("").alias("key"), col(row_key), F.lit("").alias("id_column"))
        return nothing.limit(0)
    found_any = _any([F.col(f"__w{i}").isNotNull() for i in range(len(present))])
    pairs = marked.filter(found_any).select("__row", F.explode(F.array_compact(F.array(*hits))).alias("m")).select("__row", "m.*")
    # one row per (id, priority): the choice needs no row keys
    best = pairs.select("id", "priority").distinct().groupBy("id").agg(F.min("priority").alias("priority"))
    found = pairs.join(best, ["id", "priority"])
    return found.select(F.col("id").alias("key"), F.col("__row").alias(row_key), "id_column")
