"""Staged feeds: one named table per file, all columns text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedops.functions.values import staged_name
from feedops.sources.inventory import base_name


def stage(df: DataFrame, file_name: str, keep: bool = False) -> str:
    """Registers ``df`` under the staging name of its file and returns the name.

    ``keep`` writes a table that outlives the session; otherwise it is a view.
    """
    name = df.sparkSession.range(1).select(staged_name(base_name(F.lit(file_name)))).first()[0]
    text = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])
    if keep:
        text.write.mode("overwrite").saveAsTable(name)
    else:
        text.createOrReplaceTempView(name)
    return name


def staged_tables(spark: SparkSession, prefix: str = "temp_") -> DataFrame:
    """``table_name, temporary`` of the tables whose name starts with ``prefix``.

    The catalog folds names to lower case; any case works to read a table.
    """
    names = [(t.name, t.isTemporary) for t in spark.catalog.listTables() if t.name.startswith(prefix)]
    return spark.createDataFrame(sorted(names), "table_name string, temporary boolean")


def preview(spark: SparkSession, table: str, n: int = 100) -> DataFrame:
    """First rows of a table."""
    return spark.table(table).limit(n)
