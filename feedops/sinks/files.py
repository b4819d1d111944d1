"""Every writer starts a new path or is told the mode; none reads what it replaces."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedops.plans.columns import col

#: Bytes of rows (see ``row_bytes``) up to which one task may write a file when a number of files is asked for.
FILE_BYTES = 1 << 28


def write_csv(
    df: DataFrame, path: str, gzip: bool = False, partition_by: Sequence[str] = (), mode: str = "errorifexists"
) -> None:
    """CSV with a header; NULL and empty text stay apart (``""`` is empty text)."""
    writer = df.write.mode(mode).option("header", True).option("escape", '"').option("nullValue", "")
    writer = writer.option("emptyValue", '""')
    if gzip:
        writer = writer.option("compression", "gzip")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.csv(path)


def write_json(df: DataFrame, path: str, gzip: bool = False, mode: str = "errorifexists") -> None:
    """One JSON object per line, NULL fields included."""
    writer = df.write.mode(mode).option("ignoreNullFields", False)
    (writer.option("compression", "gzip") if gzip else writer).json(path)


def write_change_log(documents: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Change documents (``key, changes``), one per line, so readers can split."""
    write_json(documents.select("key", "changes"), path, mode=mode)


def write_lines(df: DataFrame, path: str, column: str | None = None, mode: str = "errorifexists") -> None:
    """One text line per row."""
    df.select(col(column or df.columns[0]).cast("string").alias("value")).write.mode(mode).text(path)


def row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row takes: 8 for every column, and the length of texts, binaries and nested values (as text)."""
    size = F.lit(8 * len(df.columns)).cast("bigint")
    for field in df.schema:
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            size += F.coalesce(F.octet_length(col(field.name)), F.lit(0))
        elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
            size += F.coalesce(F.octet_length(col(field.name).cast("string")), F.lit(0))
    return size


def write_parquet(
    df: DataFrame, path: str, files: int | None = None, mode: str = "errorifexists", file_bytes: int = FILE_BYTES
) -> None:
    """Parquet in about ``files`` even files; without it Spark balances sizes.

    A file is written by one task, so a table of more than ``file_bytes`` of rows per file gets more files, as even. One pass
    over the columns of varying length finds the size of the table first.
    """
    if files:
        size = df.agg(F.sum(row_bytes(df))).first()[0] or 0
        out = df.repartition(max(files, -(-size // file_bytes)))
    else:
        out = df.hint("rebalance")
    out.write.mode(mode).parquet(path)


def write_records(
    records: DataFrame, path: str, prefix_len: int = 2, skip: int = 0, key: str = "id", mode: str = "errorifexists"
) -> None:
    """Record table in one folder per key prefix.

    ``skip`` passes over a common start such as a vendor code. Keep the prefix
    short: each value is a folder. A prefix that holds much of the table is
    written by several tasks.
    """
    out = records.withColumn("prefix", F.substring(col(key), skip + 1, prefix_len))
    out.hint("rebalance", "prefix").write.mode(mode).partitionBy("prefix").parquet(path)
