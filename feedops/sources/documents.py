"""Reading the JSON reports: file metadata, categories, change logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

METADATA_SCHEMA = (
    "filename string, relativePath string, effectiveDate string, rowCount bigint, "
    "columns array<struct<name:string,dataType:string>>"
)
CHANGES = "map<string,struct<column:string,previous_value:string,current_value:string>>"


def read_meta_json(spark: SparkSession, path: str | Sequence[str], lines: bool = False) -> DataFrame:
    """File metadata, as one JSON array or (``lines``) one object per line."""
    return spark.read.schema(METADATA_SCHEMA).option("multiLine", not lines).json(path)


def change_log_rows(documents: DataFrame, key: str = "key", changes: str = "changes") -> DataFrame:
    """``key, column, previous_value, current_value`` from JSON change texts."""
    parsed = F.from_json(F.col(changes), CHANGES)
    cells = documents.select(F.col(key).alias("key"), F.explode(parsed).alias("name", "cell"))
    return cells.select("key", F.col("name").alias("column"), "cell.previous_value", "cell.current_value")


def read_change_log(spark: SparkSession, path: str | Sequence[str], lines: bool = True) -> DataFrame:
    """A change log as cell rows.

    ``lines``: one ``{"key", "changes"}`` object per line, which Spark splits
    freely (what ``sinks.write_change_log`` writes). Otherwise one nested object
    per file, which has no split point: one task per file.
    """
    if lines:
        return change_log_rows(spark.read.schema("key string, changes string").json(path))
    whole = spark.read.text(path, wholetext=True)
    keyed = whole.select(F.explode(F.from_json("value", f"map<string,{CHANGES}>")).alias("key", "cells"))
    cells = keyed.select("key", F.explode("cells").alias("name", "cell"))
    return cells.select("key", F.col("name").alias("column"), "cell.previous_value", "cell.current_value")
