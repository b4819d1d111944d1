"""Which files to use: work on an inventory (``path, directory, name, size, mtime``).

Rankings keep a handful of files per directory. Spark cuts them off inside each
map task before the shuffle, so a directory with most of the files is no hot
group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedops.functions.values import name_date, name_date_text


def filter_dirs(
    inv: DataFrame, include: str | None = None, exclude: str | None = None, mode: str = "levels"
) -> DataFrame:
    """Files whose directory matches ``include`` and not ``exclude`` (regex search).

    ``levels``: every level of the path, written with a trailing slash, must
    pass, so a refused parent hides its children; files at the root always pass.
    ``leaf``: only the first level below the root is tested, by its name.
    """
    def passes(text: Column) -> Column:
        ok = F.lit(True) if include is None else text.rlike(include)
        return ok if exclude is None else ok & ~text.rlike(exclude)

    parts = F.split(F.col("directory"), "/")
    if mode == "leaf":
        return inv.filter((F.col("directory") != "") & passes(parts[0]))
    if mode != "levels":
        raise ValueError(f"unknown mode {mode!r}")
    levels = F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda i: F.concat(F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/")),
    )
    return inv.filter((F.col("directory") == "") | F.forall(levels, passes))


def folders_containing(inv: DataFrame, word: str) -> DataFrame:
    """Distinct directories with the word anywhere in their path, any case."""
    return inv.filter(F.upper("directory").contains(word.upper())).select("directory").distinct()


def with_effective_date(inv: DataFrame) -> DataFrame:
    """Adds ``date_text`` and ``effective_date`` from the file name, and ``error``
    where the name has no real date (the file stays in the list)."""
    text, day = name_date_text("name"), name_date("name")
    problem = (
        F.when(text.isNull(), F.concat(F.lit("name without a yyyymmdd date: "), F.col("name")))
        .when(day.isNull(), F.concat(F.lit("name with an impossible date: "), F.col("name")))
    )
    return inv.withColumn("date_text", text).withColumn("effective_date", day).withColumn("error", problem)


def _top(inv: DataFrame, n: int, *order: Column) -> DataFrame:
    newest = Window.partitionBy("directory").orderBy(*order)
    return inv.withColumn("rank", F.row_number().over(newest)).filter(F.col("rank") <= n)


def latest_per_dir(inv: DataFrame) -> DataFrame:
    """Newest file of each directory by the date in its name, then by name.

    Names without a real date do not take part.
    """
    dated = with_effective_date(inv).filter(F.col("effective_date").isNotNull())
    return _top(dated, 1, F.col("effective_date").desc(), F.col("name").desc()).drop("rank", "error")


def recent_per_dir(inv: DataFrame, n: int = 2) -> DataFrame:
    """The ``n`` newest files of each true parent directory by modification time."""
    return _top(inv, n, F.col("mtime").desc(), F.col("name").desc())


def total_size(picked: DataFrame) -> DataFrame:
    """Number of files and bytes of a selection."""
    return picked.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).cast("bigint").alias("total_size"))


def snapshot_pair(inv: DataFrame, by: str = "name") -> DataFrame:
    """``directory, current, previous, error``: the two newest files.

    ``by="name"``: name date, or modification time without one; modification
    time breaks ties. ``by="mtime"``: modification time only. A directory with
    fewer than two files carries an error.
    """
    mtime = F.col("mtime").cast("timestamp")
    moment = F.coalesce(name_date("name").cast("timestamp"), mtime) if by == "name" else mtime
    two = _top(inv.withColumn("__at", moment), 2, F.col("__at").desc(), F.col("mtime").desc(), F.col("name").desc())
    pairs = two.groupBy("directory").agg(
        F.max(F.when(F.col("rank") == 1, F.col("path"))).alias("current"),
        F.max(F.when(F.col("rank") == 2, F.col("path"))).alias("previous"),
    )
    return pairs.withColumn(
        "error", F.when(F.col("previous").isNull(), F.lit("a pair needs two files"))
    )


def top_files_by_rows(meta: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` files with most rows; a missing count is 0, names break ties."""
    rows = F.coalesce(F.col("rowCount"), F.lit(0))
    return meta.orderBy(rows.desc(), F.col("filename")).limit(n)
