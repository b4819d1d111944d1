"""The usual chains of operators, from folders of feeds to results."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedops.operators.diff import cell_changes, delta_rows, diff_stats
from feedops.operators.discovery import filter_dirs, folders_containing, latest_per_dir, snapshot_pair
from feedops.operators.entity import ENTITY_PREFIX, entity_history, entity_state
from feedops.operators.merge import BOOKKEEPING, load_runs, merge_newest_columns, track_keys, upsert_records
from feedops.plans.columns import col, resolve_key
from feedops.plans.keyed import Order
from feedops.sources.csv import headers_by_path, read_feed
from feedops.sources.inventory import decoded, file_inventory, logical_inventory, logical_path

SUFFIXES = (".csv", ".csv.gz")
# Columns that reading adds to a feed.
ADDED = ["_file", "_source_date", "_row", "_read_at"]


def feeds_under(spark: SparkSession, root: str, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """Inventory of the feed files under a root; a folder of part files is one file."""
    inv = logical_inventory(file_inventory(spark, root, suffixes=[]), root)
    return inv.filter(reduce(lambda a, b: a | b, [F.col("name").endswith(s) for s in suffixes], F.lit(False)))


def compare_latest(
    spark: SparkSession, folder: str, key: str, order: Order | None = None, ignore: Sequence[str] = (), nulls: str = "ignore"
) -> dict[str, DataFrame]:
    """``delta``, ``cells`` and ``stats`` of the two newest files of one folder.

    Of a repeated key the last row in the file counts, unless ``order`` says otherwise.
    """
    pairs = snapshot_pair(feeds_under(spark, folder).filter(F.col("directory") == "")).collect()
    if not pairs or pairs[0]["error"]:
        raise ValueError(f"{folder}: a pair needs two files")
    prev, curr = (read_feed(spark, pairs[0][side], row_order=True) for side in ("previous", "current"))
    order, ignore = ["_row"] if order is None else order, [*ignore, *ADDED]
    return {
        "delta": delta_rows(prev, curr, key, order, ignore, nulls).drop(*ADDED),
        "cells": cell_changes(prev, curr, key, order, ignore, nulls),
        "stats": diff_stats(prev, curr, key, order, ignore, nulls),
    }


def load_latest(
    spark: SparkSession,
    root: str,
    target: DataFrame,
    key: str,
    include: str | None = None,
    exclude: str | None = None,
    order: Order = ("_source_date", "_file", "_row"),
    **options,
) -> dict[str, DataFrame]:
    """Newest file of every matching folder merged into a record table.

    Returns the next ``records``, the ``runs`` per file and the tracked ``keys``.
    """
    newest = latest_per_dir(filter_dirs(feeds_under(spark, root), include, exclude, mode="leaf"))
    rows = read_feed(spark, newest, row_order=True, clock=True)
    key = resolve_key(rows, key)
    options["exclude"] = [*options.get("exclude", BOOKKEEPING), *ADDED]
    return {
        "records": upsert_records(target, rows, key, list(order), **options),
        "runs": load_runs(rows),
        "keys": track_keys(rows.withColumn("_name", F.element_at(F.split("_file", "/"), -1)), key, "_name"),
    }


def merge_latest(
    spark: SparkSession, root: str, word: str, key: str, order: Order = ("_row",), keep_all_keys: bool = False
) -> DataFrame:
    """Newest file of every folder with ``word`` in its path, merged column-wise,
    newest file first.

    One job reads all headers. Of files with one header only the newest can supply a column, so only that is read;
    ``keep_all_keys`` reads the keys of the others, one scan per header.
    """
    inv = feeds_under(spark, root)
    newest = latest_per_dir(inv.join(folders_containing(inv, word), "directory", "left_semi"))
    stamps = {r["path"]: f"{r['date_text']} {r['path']}" for r in newest.select("path", "date_text").toLocalIterator()}
    if not stamps:
        raise ValueError(f"{root}: no file in a folder with {word!r} in its path")
    heads: dict[str, dict[tuple, list[str]]] = {path: {} for path in stamps}
    grouped = headers_by_path(spark, list(stamps), ",", '"')
    parts = [(part, header) for header, group in grouped.items() for part in group]
    listed = spark.createDataFrame([(i, part) for i, (part, _) in enumerate(parts)], "i int, part string")
    for row in listed.select("i", logical_path(decoded(F.col("part"))).alias("path")).toLocalIterator():
        part, header = parts[row["i"]]
        heads[row["path"]].setdefault(header, []).append(part)
    bare = sorted(path for path, found in heads.items() if not found)
    if bare:
        raise ValueError(f"no header line in {', '.join(bare)}")
    supplying: dict[frozenset, str] = {}
    for path in sorted(stamps, key=stamps.get, reverse=True):
        supplying.setdefault(frozenset(heads[path]), path)
    frames = [(stamps[p], read_feed(spark, p, row_order=True, heads=heads[p]).drop("_file")) for p in supplying.values()]
    others = sorted(stamps.keys() - set(supplying.values()))
    if keep_all_keys and others:
        rest: dict[tuple, list[str]] = {}
        for path in others:
            for header, group in heads[path].items():
                rest.setdefault(header, []).extend(group)
        frames.append(("", read_feed(spark, others, heads=rest).select(col(key))))
    merged = merge_newest_columns(frames, key, {stamp: list(order) for stamp, _ in frames}, keep_all_keys)
    return merged.drop("_row")


def entities_from(
    spark: SparkSession, inputs: DataFrame, meta: DataFrame, key: str, order: Order = ("_source_date", "_file", "_row"),
    prefix: str = ENTITY_PREFIX,
) -> dict[str, DataFrame]:
    """``state`` and ``history`` of the entities in the chosen files.

    ``meta`` (``columns``) declares the column types; a column declared
    differently by two files counts as text.
    """
    declared = meta.select(F.explode("columns").alias("c")).groupBy("c.name").agg(
        F.when(F.count_distinct("c.dataType") == 1, F.first("c.dataType")).otherwise("text").alias("kind")
    )
    types = {r["name"]: r["kind"] for r in declared.collect()}
    rows = read_feed(spark, inputs, row_order=True)
    return {
        "state": entity_state(rows, key, types, list(order), prefix),
        "history": entity_history(rows, key, types, list(order), date_col="_source_date", prefix=prefix),
    }
