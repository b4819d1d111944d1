"""Merging feeds into one record per key.

A record table has ``id string, data map<string,string>``. Staged rows are
reduced to one row per key by map-side aggregation before they meet the target,
so repeated or hot keys cost nothing extra at the join.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedops.functions.values import type_value
from feedops.plans.columns import col, resolve_key, without
from feedops.plans.fold import newest_cells, newest_of
from feedops.plans.keyed import Order, last_per_key, order_struct, valid_keys

__all__ = [
    "BOOKKEEPING", "RESERVED_WORDS", "attribute_names", "load_report", "load_runs", "measured_seconds", "merge_newest_columns",
    "newest_values", "to_records", "track_keys", "track_keys_by_file", "upsert_preview", "upsert_records",
    "valid_keys", "verify_records",
]

# Staged columns that never become attributes.
BOOKKEEPING = ["created_at", "updated_at", "filedate", "rownumber"]
# Attribute names that get an underscore in front.
RESERVED_WORDS = [
    "rownumber", "order", "group", "user", "table", "column", "select", "from", "where", "update", "delete",
    "insert", "create", "drop", "alter", "index", "view", "sequence", "trigger", "function", "procedure", "schema",
    "database", "constraint", "primary", "foreign", "key", "unique", "check", "default", "null", "not", "and", "or",
    "as", "on", "in", "exists", "between", "like", "ilike", "is", "all", "any", "some", "distinct", "having",
    "limit", "offset", "union", "intersect", "except", "case", "when", "then", "else", "end", "true", "false",
    "unknown",
]


def merge_newest_columns(
    frames: Sequence[tuple[str, DataFrame]],
    key: str,
    order: Mapping[str, Order] | None = None,
    keep_all_keys: bool = False,
    dedupe: bool = True,
) -> DataFrame:
    """Wide merge of ``(date, frame)`` pairs, newest first.

    A column comes only from the newest frame that has it and is never filled
    from an older one. A frame without new columns adds nothing, not even keys,
    unless ``keep_all_keys``. ``dedupe`` keeps one row per key in every frame
    (the last by ``order[date]``, else the one with the largest values).
    """
    taken: set[str] = {key}
    parts: list[tuple[str, list[str], DataFrame]] = []
    for date, frame in sorted(frames, key=lambda f: f[0], reverse=True):
        new = [c for c in frame.columns if c not in taken]
        if parts and not new and not keep_all_keys:
            continue
        taken.update(new)
        parts.append((date, new, valid_keys(frame, key)))
    if not parts:
        raise ValueError("nothing to merge")
    if not dedupe:
        slim = [f.select(key, *[col(c) for c in new]) if new else f.select(key).distinct() for _, new, f in parts]
        return reduce(lambda a, b: a.join(b, key, "full_outer"), slim)

    # every frame once through one shuffle: a chain of outer joins would move the
    # growing result again for each frame
    tagged, newest, names = [], [], []
    for i, (date, new, frame) in enumerate(parts):
        if not new:
            tagged.append(frame.select(col(key).alias(key)))
            continue
        by = (order or {}).get(date) or new
        tagged.append(
            frame.select(
                col(key).alias(key), F.struct(*[col(c) for c in new]).alias(f"__r{i}"), order_struct(by).alias(f"__o{i}")
            )
        )
        newest.append(F.max_by(f"__r{i}", f"__o{i}").alias(f"__r{i}"))
        names += [(f"__r{i}", c) for c in new]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    merged = every.groupBy(key).agg(*newest) if newest else every.distinct()
    return merged.select(col(key), *[F.col(r)[c].alias(c) for r, c in names])


def newest_values(df: DataFrame, key: str, columns: Sequence[str], order: Order, nulls: str = "keep") -> DataFrame:
    """One row per key with the newest value of each column.

    ``keep``: the newest value that is not NULL. ``overwrite``: the newest row
    as it is, NULLs included.
    """
    if nulls == "overwrite":
        return last_per_key(df, key, order, [key, *columns])
    if nulls != "keep":
        raise ValueError(f"unknown null policy {nulls!r}")
    rows = valid_keys(df, key).select(
        col(key).cast("string").alias("__key"), order_struct(order).alias("__at"), *[col(c).alias(f"__c{i}") for i, c in enumerate(columns)]
    )
    cells = [f"__c{i}" for i in range(len(columns))]
    if not cells:
        return rows.select(F.col("__key").alias(key)).distinct()
    newest = newest_cells(rows, ["__key"], cells, "__at").groupBy("__key").agg(*[newest_of(c, "__at").alias(c) for c in cells])
    return newest.select(F.col("__key").alias(key), *[F.col(c).alias(name) for c, name in zip(cells, columns)])


def attribute_names(
    columns: Sequence[str], key: str, exclude: Sequence[str] = BOOKKEEPING, key_case: str = "as_is",
    reserved: str = "keep",
) -> dict[str, str]:
    """``{column: attribute}``: key and bookkeeping columns out, names adjusted."""
    out = {}
    for name in without(columns, [key, *exclude]):
        attribute = name.lower() if key_case == "lower" else name
        if reserved == "prefix" and attribute in RESERVED_WORDS:
            attribute = f"_{attribute}"
        out[name] = attribute
    return out


def to_records(
    staged: DataFrame,
    key: str,
    order: Order | None = None,
    null_policy: str = "keep",
    exclude: Sequence[str] = BOOKKEEPING,
    key_case: str = "as_is",
    reserved: str = "keep",
    strip_nulls: bool = False,
    typed: bool = True,
) -> DataFrame:
    """Staged rows as one record per key: ``id, data``.

    ``order`` says which of several rows of a key is newer; without it the
    order of all columns decides. ``typed`` applies the document typing of
    cells, which turns null tokens into NULL.
    """
    found = resolve_key(staged, key)
    names = attribute_names(staged.columns, found, exclude, key_case, reserved)
    if typed:
        values: dict[str, Column] = {c: type_value(col(c).cast("string"))["value"] for c in names}
    else:
        values = {c: col(c).cast("string") for c in names}
    by = order_struct(order if order is not None else list(staged.columns))
    rows = staged.select(col(found), by.alias("__order"), *[v.alias(c) for c, v in values.items()])
    newest = newest_values(rows, found, list(names), [F.col("__order")], null_policy)
    entries = [x for c, a in names.items() for x in (F.lit(a), col(c))]
    data = F.create_map(*entries) if entries else F.create_map().cast("map<string,string>")
    records = newest.select(col(found).alias("id"), data.alias("data"))
    return strip(records) if strip_nulls else records


def strip(records: DataFrame, data: str = "data") -> DataFrame:
    """Records without NULL attributes."""
    return records.withColumn(data, F.map_filter(col(data), lambda _, v: v.isNotNull()))


def _merged(old: Column, new: Column, null_policy: str) -> Column:
    if null_policy == "overwrite":
        data = F.map_zip_with(old, new, lambda k, a, b: F.when(F.map_contains_key(new, k), b).otherwise(a))
    else:
        data = F.map_zip_with(old, new, lambda _, a, b: F.coalesce(b, a))
    return F.when(new.isNull(), old).when(old.isNull(), new).otherwise(data)


def _paired(target: DataFrame, records: DataFrame, insert_missing: bool = True) -> DataFrame:
    old = target.select(F.col("id"), F.col("data").alias("__old"), F.lit(True).alias("__had"))
    new = records.select(F.col("id"), F.col("data").alias("__new"), F.lit(True).alias("__got"))
    return old.join(new, "id", "full_outer" if insert_missing else "left")


def upsert_records(
    target: DataFrame,
    staged: DataFrame,
    key: str,
    order: Order | None = None,
    null_policy: str = "keep",
    insert_missing: bool = True,
    strip_nulls: bool = False,
    **naming,
) -> DataFrame:
    """The next version of a record table (``id, data``).

    New keys are inserted. For known keys incoming attributes win and absent
    ones stay; a NULL does not overwrite unless ``null_policy="overwrite"``.
    ``insert_missing=False`` updates only. Write the result to a new path.
    """
    records = to_records(staged, key, order, null_policy, **naming)
    data = _merged(F.col("__old"), F.col("__new"), null_policy)
    out = _paired(target, records, insert_missing).select("id", data.alias("data"))
    return strip(out) if strip_nulls else out


def upsert_preview(
    target: DataFrame, staged: DataFrame, key: str, order: Order | None = None, null_policy: str = "keep", **naming
) -> DataFrame:
    """``inserted, updated, unchanged`` an upsert of the staged rows would give.

    ``unchanged`` counts staged keys whose record would stay as it is.
    """
    records = to_records(staged, key, order, null_policy, **naming)
    pairs = _paired(target, records).filter(F.col("__got"))
    after = _merged(F.col("__old"), F.col("__new"), null_policy)
    entries = lambda m: F.array_sort(F.map_entries(m))
    known = F.col("__had").isNotNull()
    same = known & entries(after).eqNullSafe(entries(F.col("__old")))
    return pairs.agg(
        F.count_if(~known).alias("inserted"), F.count_if(known & ~same).alias("updated"), F.count_if(same).alias("unchanged")
    )


def measured_seconds(df: DataFrame, file_col: str = "_file", clock_col: str = "_read_at") -> DataFrame:
    """``file_path, processing_time_seconds``: how long the rows of each file took to read.

    ``clock_col`` holds the task and the clock of each row as it was read (``sources.csv.with_clock``). A task reads one
    part of a file after the other, so a part took from the last row of the part before (its own first row, if it is the
    task's first) to its last row; the parts of a file add up. No time is below the clock's step of a nanosecond.
    """
    task, at = F.col(f"{clock_col}.task"), F.col(f"{clock_col}.nanos")
    parts = df.groupBy(col(file_col).alias("file_path"), task.alias("task")).agg(F.min(at).alias("first"), F.max(at).alias("last"))
    before = F.lag("last").over(Window.partitionBy("task").orderBy("first"))
    spent = parts.withColumn("spent", F.col("last") - F.least(F.coalesce(before, F.col("first")), F.col("first")))
    return spent.groupBy("file_path").agg((F.greatest(F.sum("spent"), F.lit(1)) / 1e9).alias("processing_time_seconds"))


def load_runs(
    df: DataFrame, file_col: str = "_file", bad_row: Column | None = None, files: DataFrame | None = None,
    seconds: DataFrame | None = None, clock_col: str = "_read_at",
) -> DataFrame:
    """``file_path, status, rows_processed, error_message, processing_time_seconds``
    of the files behind ``df``.

    A file with rows that satisfy ``bad_row`` has status ``error``. ``files``, an
    inventory (``path``, perhaps ``error``), adds the files without rows and fails
    those with an error. Times are measured where ``df`` has ``clock_col``
    (``read_feed(clock=True)``); ``seconds`` (``file_path, processing_time_seconds``)
    holds times of the caller's own.
    """
    if seconds is None and clock_col in df.columns:
        seconds = measured_seconds(df, file_col, clock_col)
    bad = F.count_if(bad_row if bad_row is not None else F.lit(False))
    runs = df.groupBy(col(file_col).alias("file_path")).agg(F.count("*").alias("__all"), bad.alias("__bad"))
    if files is not None:
        problem = col("error") if "error" in files.columns else F.lit(None)
        listed = files.select(col("path").alias("file_path"), problem.cast("string").alias("__error"))
        runs = listed.join(runs, "file_path", "full_outer")
    else:
        runs = runs.withColumn("__error", F.lit(None).cast("string"))
    rows, bad_rows = (F.coalesce(c, F.lit(0)) for c in ("__all", "__bad"))
    unreadable = F.when(rows == 0, F.coalesce("__error", F.lit("no rows")))
    malformed = F.when(bad_rows > 0, F.concat(bad_rows.cast("string"), F.lit(" malformed rows")))
    message = F.coalesce("__error", unreadable, malformed)
    timed = runs.withColumn("processing_time_seconds", F.lit(None).cast("double")) if seconds is None else runs.join(seconds, "file_path", "left")
    return timed.select(
        "file_path",
        F.when(message.isNotNull(), "error").otherwise("success").alias("status"),
        (rows - bad_rows).alias("rows_processed"),
        message.alias("error_message"),
        F.col("processing_time_seconds").cast("double").alias("processing_time_seconds"),
    )


def load_report(runs: DataFrame) -> DataFrame:
    """Totals over load runs (``file_path, status, rows_processed,
    processing_time_seconds``): files by status, rows of successful files, time,
    time per file and rows per second. List the runs slowest first with
    ``runs.orderBy(desc("processing_time_seconds"))``."""
    ok = F.col("status") == "success"
    seconds = F.sum("processing_time_seconds")
    rows = F.sum(F.when(ok, F.col("rows_processed")))
    return runs.agg(
        F.count("*").alias("total_files"),
        F.count_if(ok).alias("successful_files"),
        F.count_if(F.col("status") == "error").alias("failed_files"),
        F.coalesce(rows, F.lit(0)).alias("total_rows"),
        seconds.alias("total_seconds"),
        F.avg("processing_time_seconds").alias("seconds_per_file"),
        F.try_divide(rows, seconds).alias("rows_per_second"),
    )


def verify_records(records: DataFrame, data: str = "data") -> DataFrame:
    """``total_records, with_data, empty_records, total_attributes, min_attributes,
    max_attributes`` of a record table."""
    n = F.coalesce(F.size(F.map_keys(col(data))), F.lit(0)).cast("bigint")
    return records.select(n.alias("n"), col(data).isNotNull().alias("has")).agg(
        F.count("*").alias("total_records"),
        F.count_if("has").alias("with_data"),
        F.count_if(F.col("n") == 0).alias("empty_records"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_attributes"),
        F.min("n").alias("min_attributes"),
        F.max("n").alias("max_attributes"),
    )


def attribute_counts(records: DataFrame, key: str = "id", data: str = "data") -> DataFrame:
    """Number of attributes of every record."""
    return records.select(col(key), F.coalesce(F.size(F.map_keys(col(data))), F.lit(0)).alias("attributes"))


def track_keys_by_file(df: DataFrame, key: str, file_col: str) -> DataFrame:
    """``key, file, count``: occurrences of each key in each file."""
    return valid_keys(df, key).groupBy(col(key).cast("string").alias("key"), col(file_col).alias("file")).agg(
        F.count("*").alias("count")
    )


def track_keys(df: DataFrame, key: str, file_col: str, ordered: bool = True) -> DataFrame:
    """``KEY, COUNT, EXISTS_IN``: occurrences and the sorted files of each key.

    Counting per key and file comes first, so what is gathered per key is at
    most one entry per file, never its rows.
    """
    per_file = track_keys_by_file(df, key, file_col)
    out = per_file.groupBy(F.col("key").alias("KEY")).agg(
        F.sum("count").alias("COUNT"), F.array_join(F.array_sort(F.collect_list("file")), ",").alias("EXISTS_IN")
    )
    return out.orderBy(F.col("COUNT").desc(), "KEY") if ordered else out
