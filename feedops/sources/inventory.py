"""File inventories: one row per file, without opening the files."""

from __future__ import annotations

import re
import warnings
from collections.abc import Sequence
from urllib.parse import urlsplit

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def decoded(path: Column) -> Column:
    """File path as people write it (``%20`` and the like undone), with one form
    for local paths."""
    plain = F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(F.coalesce(plain, path), "^file:/+", "file:/")


def logical_path(path: Column) -> Column:
    """The file a path belongs to: a folder of part files as Spark names them is one file."""
    return F.regexp_replace(path, r"/part-[0-9]{5,}-[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}[^/]*$", "")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def with_names(df: DataFrame, root: str = "") -> DataFrame:
    """Adds ``directory`` (relative to ``root``) and ``name`` to rows with ``path``.

    Scheme and host are left out on both sides, as a root is often given without.
    """
    relative = F.regexp_replace("path", "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?/*", "/") if root else F.col("path")
    prefix = re.sub("/+$", "", re.sub("^/*", "/", urlsplit(root).path)) if root else ""
    if prefix:
        at = F.instr(relative, prefix + "/")
        relative = F.when(at > 0, F.substr(relative, at + len(prefix) + 1)).otherwise(relative)
    folder = F.when(relative.contains("/"), parent(relative)).otherwise(F.lit(""))
    return df.withColumn("directory", F.ltrim(folder, F.lit("/"))).withColumn("name", base_name(F.col("path")))


def file_inventory(
    spark: SparkSession,
    root: str | Sequence[str],
    suffixes: Sequence[str] = (".csv", ".csv.gz"),
    recursive: bool = True,
    empty_files: bool = True,
) -> DataFrame:
    """``path, directory, name, size, mtime`` of the files under a root.

    The listing is Spark's own (spread over executors for many folders); file
    bodies are not read. Spark's scans pass over files of no bytes; they are
    added, with size 0, from the listing itself unless ``empty_files`` is off.
    """
    roots = [root] if isinstance(root, str) else list(root)
    scan = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(roots)
    # this column holds plain paths, unlike those of the listing
    plain = F.regexp_replace("path", "^file:/+", "file:/")
    files = scan.select(plain.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    if empty_files:
        listed = spark.createDataFrame([(p,) for p in scan.inputFiles()], "path string")
        listed = listed.select(decoded(F.col("path")).alias("path"))
        files = listed.join(files, "path", "left").withColumn("size", F.coalesce("size", F.lit(0)))
    if suffixes:
        wanted = F.lit(False)
        for suffix in suffixes:
            wanted = wanted | F.col("path").endswith(suffix)
        files = files.filter(wanted)
    named = with_names(files, roots[0] if len(roots) == 1 else "")
    return named.select("path", "directory", "name", "size", "mtime")


def expand_paths(spark: SparkSession, patterns: Sequence[str]) -> DataFrame:
    """Files that match any glob, each once, in path order, empty ones included.

    A pattern without a match is reported and skipped. Only the listing is used,
    no file is opened.
    """
    listed: set[str] = set()
    for pattern in patterns:
        try:
            listed.update(spark.read.format("binaryFile").load(pattern).inputFiles())
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            warnings.warn(f"nothing matches {pattern}", stacklevel=2)
    paths = spark.createDataFrame([(p,) for p in sorted(listed)], "path string")
    return paths.select(decoded(F.col("path")).alias("path")).distinct().orderBy("path")


def logical_inventory(inv: DataFrame, root: str = "") -> DataFrame:
    """Inventory in which a folder of ``part-`` files counts as one file."""
    whole = inv.groupBy(logical_path(F.col("path")).alias("path")).agg(
        F.sum("size").alias("size"), F.max("mtime").alias("mtime")
    )
    return with_names(whole, root).select("path", "directory", "name", "size", "mtime")


def require_nonempty(inv: DataFrame) -> DataFrame:
    """Inventory with ``ok`` and ``error``: a file of no bytes is refused. ``csv.require_rows`` looks inside too."""
    empty = F.col("size") <= 0
    return inv.withColumn("ok", ~empty).withColumn(
        "error", F.when(empty, F.concat(F.lit("no bytes in "), F.col("path")))
    )
