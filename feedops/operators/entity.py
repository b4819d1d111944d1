"""State and dated history of entities, from typed feed rows.

Rows are text frames with ``_file`` (source file name) and ``_date`` (effective
date, ``yyyymmdd``); ``order`` puts later rows last. Column types come from file
metadata: ``{column: declared type}``, declared columns only.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedops.functions.values import converted_value, holds_text
from feedops.operators.discovery import latest_per_dir
from feedops.plans.columns import col
from feedops.plans.fold import newest_cells, newest_of
from feedops.plans.keyed import Order, order_struct

# Start of a valid entity identifier.
ENTITY_PREFIX = "BBG"
# Declared types in which a text with letters is a mismatch.
NUMERIC_TYPES = ["integer", "float"]


def valid_entities(df: DataFrame, key: str, prefix: str = ENTITY_PREFIX) -> DataFrame:
    """Rows whose identifier starts with the prefix."""
    return df.filter(col(key).startswith(prefix))


def _declared(df: DataFrame, key: str, types: Mapping[str, str]) -> dict[str, str]:
    return {c: types[c] for c in df.columns if c in types and c != key}


def _converted(df: DataFrame, key: str, types: Mapping[str, str], order: Order, keep: Sequence[str] = ()) -> DataFrame:
    cells = [converted_value(col(c), t).alias(c) for c, t in _declared(df, key, types).items()]
    return df.select(col(key).alias(key), order_struct(order).alias("__order"), *[col(k) for k in keep], *cells)


def entity_state(df: DataFrame, key: str, types: Mapping[str, str], order: Order, prefix: str = ENTITY_PREFIX) -> DataFrame:
    """Current values per entity: later rows win, null tokens and unfit cells are
    skipped, undeclared columns are left out. One shuffle, reduced before it."""
    declared = _declared(df, key, types)
    rows = _converted(valid_entities(df, key, prefix), key, types, order)
    if not declared:
        return rows.select(col(key).alias(key)).distinct()
    cells = newest_cells(rows, [key], list(declared), "__order")
    return cells.groupBy(col(key).alias(key)).agg(*[newest_of(c, "__order").alias(c) for c in declared])


def entity_records(
    df: DataFrame, key: str, types: Mapping[str, str], order: Order, prefix: str = ENTITY_PREFIX
) -> DataFrame:
    """``id, data``: the state as a record, skipped values left out."""
    state = entity_state(df, key, types, order, prefix)
    entries: list[Column] = [x for c in state.columns if c != key for x in (F.lit(c), col(c))]
    data = F.map_filter(F.create_map(*entries), lambda _, v: v.isNotNull())
    return state.select(col(key).alias("id"), data.alias("data"))


def entity_history(
    df: DataFrame,
    key: str,
    types: Mapping[str, str],
    order: Order,
    file_col: str = "_file",
    date_col: str = "_date",
    prefix: str = ENTITY_PREFIX,
) -> DataFrame:
    """``id, property, effective_date, file, value``: the last value a property got
    on each date, and the file it came from."""
    declared = list(_declared(df, key, types))
    rows = _converted(valid_entities(df, key, prefix), key, types, [*order, file_col], [file_col, date_col])
    # one wide row per id and date: fewer rows to sort than one per property
    last = [
        F.max_by(
            F.struct(col(file_col).alias("file"), col(c).alias("value")),
            F.when(col(c).isNotNull(), F.col("__order")),
        ).alias(f"__v{i}")
        for i, c in enumerate(declared)
    ]
    if not declared:
        nothing = "id string, property string, effective_date string, file string, value string"
        return df.sparkSession.createDataFrame([], nothing)
    cells = newest_cells(rows.filter(col(date_col).isNotNull()), [key, date_col], declared, "__order")
    wide = cells.groupBy(col(key).alias("id"), col(date_col).alias("effective_date"))
    entry = [
        F.when(F.col(f"__v{i}").isNotNull(), F.struct(F.lit(c).alias("property"), F.col(f"__v{i}").alias("last")))
        for i, c in enumerate(declared)
    ]
    long = wide.agg(*last).select("id", "effective_date", F.explode(F.array(*entry)).alias("e"))
    return long.filter(F.col("e").isNotNull()).select(
        "id", "e.property", "effective_date", "e.last.file", "e.last.value"
    )


def history_documents(history: DataFrame) -> DataFrame:
    """``id, property, history``: dates of a property as one JSON object
    ``{date: {file, value}}``; bounded by the number of feed dates."""
    entry = F.struct(F.col("effective_date").alias("k"), F.struct("file", "value").alias("v"))
    grouped = history.groupBy("id", "property").agg(F.array_sort(F.collect_list(entry)).alias("h"))
    return grouped.select("id", "property", F.to_json(F.map_from_entries("h")).alias("history"))


def type_mismatches(
    df: DataFrame, types: Mapping[str, str], file_col: str = "_file", key: str | None = None
) -> DataFrame:
    """``filename, column, declared_type, actual_type``: columns declared numeric
    that held text. One flag per column and file; no cell rows are made.

    With ``key`` only rows of valid entities are looked at, as in the load.
    """
    rows = df if key is None else valid_entities(df, key)
    numeric = {c: t for c, t in types.items() if t in NUMERIC_TYPES and c in df.columns}
    if not numeric:
        return df.sparkSession.createDataFrame([], "filename string, column string, declared_type string, actual_type string")
    flags = [
        F.max(holds_text(col(c), t)).alias(f"__f{i}") for i, (c, t) in enumerate(numeric.items())
    ]
    per_file = rows.groupBy(col(file_col).alias("filename")).agg(*flags)
    entry = [
        F.struct(F.lit(c).alias("column"), F.lit(t).alias("declared_type"), F.col(f"__f{i}").alias("hit"))
        for i, (c, t) in enumerate(numeric.items())
    ]
    listed = per_file.select("filename", F.explode(F.array(*entry)).alias("e")).filter(F.col("e.hit"))
    return listed.select("filename", "e.column", "e.declared_type", F.lit("text").alias("actual_type"))


def correct_metadata(meta: DataFrame, mismatches: DataFrame) -> DataFrame:
    """Metadata (``filename, columns``, other fields kept) in which the reported
    columns have the type they were found to hold."""
    fixes = mismatches.groupBy("filename").agg(
        F.map_from_entries(F.collect_set(F.struct("column", "actual_type"))).alias("__fix")
    )
    fixed = F.transform(
        "columns",
        lambda c: F.struct(
            c["name"].alias("name"),
            F.coalesce(F.try_element_at(F.col("__fix"), c["name"]), c["dataType"]).alias("dataType"),
        ),
    )
    joined = meta.join(fixes, "filename", "left")
    return joined.withColumn("columns", fixed).select(*meta.columns)


def entity_inputs(inv: DataFrame, categories: DataFrame, category: str = "asset") -> DataFrame:
    """Newest file of every directory whose feed is in the category.

    A feed is named by the last level of its directory.
    """
    wanted = categories.filter(F.col("category") == category).select("filename").distinct()
    newest = latest_per_dir(inv).withColumn("__feed", F.element_at(F.split("directory", "/"), -1))
    return newest.join(wanted, F.col("__feed") == F.col("filename"), "left_semi").drop("__feed")
