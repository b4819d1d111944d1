"""Counts, value frequencies, numeric profiles, type inference, file metadata."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedops.functions.values import (
    INFERENCE_NULL_TOKENS,
    is_boolean,
    is_date,
    is_integer,
    is_number,
    is_timestamp,
    name_date,
    name_date_text,
)
from feedops.plans.columns import col, require_columns
from feedops.plans.selection import values_at

# Inferred types, most specific first.
INFERRED_TYPES = ["integer", "numeric", "date", "timestamp", "boolean"]
# The column that puts a file into a category, first match wins.
CATEGORY_RULES = [("asset", "ID_BB_GLOBAL"), ("company", "ID_BB_COMPANY")]
QUARTILES = [0.25, 0.5, 0.75]
# Most values of a column that the built-in exact percentile may gather.
BUILT_IN = 200_000
# Long columns searched together, so that generated code stays small.
AT_ONCE = 20


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("row_count"))


def value_counts(df: DataFrame, column: str, min_count: int = 1, ordered: bool = True) -> DataFrame:
    """``value, count`` of the non-null values, most frequent first."""
    require_columns(df, [column])
    counts = (
        df.filter(col(column).isNotNull()).groupBy(col(column).alias("value")).agg(F.count("*").alias("count"))
    )
    kept = counts.filter(F.col("count") >= min_count) if min_count > 1 else counts
    return kept.orderBy(F.col("count").desc(), "value") if ordered else kept


def value_count_summary(df: DataFrame, column: str, min_count: int = 1) -> DataFrame:
    """``total_rows, unique_values, kept_values, excluded_values``; NULLs count as
    rows only. One pass: the NULL group carries their number."""
    counts = df.groupBy(col(column).alias("value")).agg(F.count("*").alias("n"))
    real = F.col("value").isNotNull()
    return counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"),
        F.count_if(real).alias("unique_values"),
        F.count_if(real & (F.col("n") >= min_count)).alias("kept_values"),
        F.count_if(real & (F.col("n") < min_count)).alias("excluded_values"),
    )


def merge_counts(frames: Sequence[DataFrame], ordered: bool = True) -> DataFrame:
    """Value counts of several files summed by value, most frequent first."""
    for frame in frames:
        missing = {"value", "count"} - set(frame.columns)
        if missing:
            raise ValueError(f"a count table needs the columns value and count (missing {sorted(missing)})")
    every = reduce(DataFrame.unionByName, [f.select("value", F.col("count").cast("bigint")) for f in frames])
    merged = every.filter(F.col("value").isNotNull()).groupBy("value").agg(F.sum("count").alias("count"))
    return merged.orderBy(F.col("count").desc(), "value") if ordered else merged


def merge_summary(merged: DataFrame, files: int) -> DataFrame:
    """``files, unique_values, total_count`` of merged counts."""
    return merged.agg(
        F.lit(files).alias("files"), F.count("*").alias("unique_values"),
        F.coalesce(F.sum("count"), F.lit(0)).alias("total_count"),
    )


def _sampled(df: DataFrame, frac: float | None, seed: int) -> DataFrame:
    return df if frac is None else df.sample(fraction=frac, seed=seed)


def top_values(df: DataFrame, column: str, n: int = 20, frac: float | None = None, seed: int = 0) -> DataFrame:
    """The ``n`` most frequent values, optionally of a random fraction."""
    counts = value_counts(_sampled(df.select(col(column)), frac, seed), column, ordered=False)
    return counts.orderBy(F.col("count").desc(), "value").limit(n)


def numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns as doubles; NaN counts as missing."""
    kinds = {f.name: f.dataType for f in df.schema}
    out = []
    for c in columns:
        v = col(c).cast("double")
        whole = isinstance(kinds[c], (T.IntegralType, T.DecimalType))
        out.append((v if whole else F.when(~F.isnan(v), v)).alias(c))
    return df.select(*out)


def quantiles(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], sizes: Mapping[str, int] | None = None
) -> DataFrame:
    """``column, probability, quantile``: exact, interpolated between neighbours.

    Columns of up to ``BUILT_IN`` values go through Spark's own exact percentile,
    whose memory grows with the values. For longer ones ranks are found by
    narrowing value ranges (a few aggregating jobs), so no task holds a column.
    """
    data = numbers(df, columns)
    if sizes is None:
        sizes = data.agg(*[F.count(col(c)).alias(c) for c in columns]).collect()[0].asDict()
    rows = []
    short = [c for c in columns if 0 < sizes[c] <= BUILT_IN]
    if short:
        exact = [F.percentile(col(c), [float(p) for p in probabilities]).alias(f"q{i}") for i, c in enumerate(short)]
        found = data.agg(*exact).collect()[0]
        rows += [(c, float(p), v) for i, c in enumerate(short) for p, v in zip(probabilities, found[f"q{i}"])]
    at = {(c, p): (sizes[c] - 1) * p for c in columns for p in probabilities if sizes[c] > BUILT_IN}
    if at:
        ranks: dict[str, list[int]] = {c: [] for c, _ in at}
        for (c, _), position in at.items():
            ranks[c] += [math.floor(position), math.ceil(position)]
        values, long = {}, list(ranks)
        for i in range(0, len(long), AT_ONCE):
            values.update(values_at(data, {c: ranks[c] for c in long[i:i + AT_ONCE]}, sizes))
        for (c, p), position in at.items():
            low, high = values[c, math.floor(position)], values[c, math.ceil(position)]
            rows.append((c, float(p), low + (high - low) * (position - math.floor(position))))
    return df.sparkSession.createDataFrame(rows, "column string, probability double, quantile double")


def describe(
    df: DataFrame, columns: Sequence[str], frac: float | None = None, approximate: bool = False, seed: int = 0
) -> DataFrame:
    """One row per numeric column: ``column, count, mean, std, min, q25, q50, q75, max``.

    Runs its jobs at once; nothing but the figures themselves reaches the driver.
    ``approximate`` takes quartiles from one-pass sketches instead of exact ranks.
    """
    require_columns(df, columns)
    data = _sampled(numbers(df, columns), frac, seed)
    basic = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    flat = []
    for i, c in enumerate(columns):
        flat += [fn(col(c)).alias(f"{n}{i}") for n, fn in basic.items()]
        if approximate:
            flat.append(F.percentile_approx(col(c), QUARTILES, 10000).alias(f"q{i}"))
    found = data.agg(*flat).collect()[0]
    if approximate:
        quartiles = {(c, p): v for i, c in enumerate(columns) for p, v in zip(QUARTILES, found[f"q{i}"] or [])}
    else:
        ranks = quantiles(data, columns, QUARTILES, {c: found[f"count{i}"] for i, c in enumerate(columns)})
        quartiles = {(r["column"], r["probability"]): r["quantile"] for r in ranks.collect()}
    rows = [
        (c, *[found[f"{n}{i}"] for n in ("count", "mean", "std", "min")], *[quartiles.get((c, p)) for p in QUARTILES],
         found[f"max{i}"])
        for i, c in enumerate(columns)
    ]
    return df.sparkSession.createDataFrame(
        rows, "column string, count bigint, mean double, std double, min double, q25 double, q50 double, q75 double, max double"
    )


def column_stats(
    df: DataFrame, column: str, frac: float | None = None, approximate: bool = False, n: int = 20
) -> DataFrame:
    """Numeric profile or top ``n`` values of a column, by its type, with the
    number of rows looked at and the fraction asked for."""
    require_columns(df, [column])
    data = _sampled(df.select(col(column)), frac, 0)
    size = data.agg(F.count("*")).scalar()
    numeric = isinstance(df.schema[column].dataType, T.NumericType)
    found = describe(data, [column], approximate=approximate) if numeric else top_values(data, column, n)
    return found.withColumn("sample_size", size).withColumn("sample_fraction", F.lit(float(frac or 1.0)))


def _type_flags(columns: Mapping[str, Column]) -> list[Column]:
    out = []
    for i, c in enumerate(columns.values()):
        real = c.isNotNull() & ~F.lower(c).isin(INFERENCE_NULL_TOKENS)
        tests = [is_integer(c), is_number(c), is_date(c), is_timestamp(c), is_boolean(c)]
        out += [F.min(F.when(real, t)).alias(f"__t{i}_{k}") for k, t in enumerate(tests)]
    return out


def _inferred(i: int) -> Column:
    kind = F.when(F.col(f"__t{i}_0"), INFERRED_TYPES[0])
    for k in range(1, len(INFERRED_TYPES)):
        kind = kind.when(F.col(f"__t{i}_{k}"), INFERRED_TYPES[k])
    return kind.otherwise("text")


def infer_types(
    df: DataFrame, order_by: Sequence[str | Column] = (), sample: int | None = None,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """``position, name, data_type`` of text columns from all rows, or from the first
    ``sample`` rows in ``order_by``. A column without values is text."""
    names = list(columns) if columns is not None else df.columns
    rows = df if sample is None else (df.orderBy(*order_by) if order_by else df).limit(sample)
    flags = rows.agg(*_type_flags({n: col(n) for n in names}))
    listed = F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(n).alias("name"), _inferred(i).alias("data_type"))
        for i, n in enumerate(names)
    ])
    return flags.select(F.explode(listed).alias("c")).select("c.*")


def file_metadata(
    df: DataFrame, columns: Sequence[str], file_col: str = "_file", row_col: str = "_row", sample: int | None = None
) -> DataFrame:
    """``path, rowCount, columns`` per file of a text frame with one header.

    One hash aggregate over all rows gives counts and types. With ``sample`` the
    types come from the first so many rows of each file, which Spark cuts off inside the map tasks.
    """
    rows = F.count("*").alias("rowCount")
    tests = _type_flags({n: col(n) for n in columns})
    if sample is None:
        flags = df.groupBy(col(file_col).alias("path")).agg(rows, *tests)
    else:
        first = Window.partitionBy(file_col).orderBy(col(row_col))
        heads = df.withColumn("__n", F.row_number().over(first)).filter(F.col("__n") <= sample)
        counts = df.groupBy(col(file_col).alias("path")).agg(rows)
        flags = counts.join(heads.groupBy(col(file_col).alias("path")).agg(*tests), "path")
    listed = F.array(*[
        F.struct(F.lit(n).alias("name"), _inferred(i).alias("dataType")) for i, n in enumerate(columns)
    ])
    return flags.select("path", "rowCount", listed.alias("columns"))


def extract_metadata(
    spark: SparkSession, root: str, suffixes: Sequence[str] = (".gz",), sep: str = ",", quote: str = '"',
    sample: int | None = None,
) -> DataFrame:
    """``filename, relativePath, effectiveDate, rowCount, columns, error`` of every
    feed file under a root.

    ``filename`` is the folder a file lies in. One scan per distinct header. A
    file without a date in its name, or without a header line, is listed with an error.
    """
    from feedops.sources.csv import _read, headers_by_path, with_file, with_row_order

    nothing = "path string, rowCount bigint, columns array<struct<name:string,dataType:string>>"
    from feedops.sources.inventory import base_name, file_inventory, logical_inventory, parent

    inv = logical_inventory(file_inventory(spark, root, suffixes), root)
    paths = [r["path"] for r in inv.select("path").toLocalIterator()]
    parts = []
    for (names, *used), group in (headers_by_path(spark, paths, sep, quote) if paths else {}).items():
        rows = with_row_order(with_file(_read(spark, group, names, *used)))
        parts.append(file_metadata(rows, names, sample=sample))
    found = reduce(DataFrame.unionByName, parts, spark.createDataFrame([], nothing))
    sized = inv.join(found, "path", "left")
    name = base_name(F.col("path"))
    problem = F.when(name_date(name).isNull(), F.concat(F.lit("no effective date in "), name)).when(
        F.col("columns").isNull(), F.concat(F.lit("no rows in "), name)
    )
    return sized.select(
        base_name(parent(F.col("path"))).alias("filename"),
        F.when(F.col("directory") != "", F.concat_ws("/", "directory", "name")).otherwise(name).alias("relativePath"),
        F.when(name_date(name).isNotNull(), name_date_text(name)).alias("effectiveDate"),
        F.coalesce("rowCount", F.lit(0)).alias("rowCount"),
        F.col("columns"),
        problem.alias("error"),
    )


def categorise(meta: DataFrame, rules: Sequence[tuple[str, str]] = tuple(CATEGORY_RULES)) -> DataFrame:
    """``filename, category`` by the columns a file has; ``exception`` if none fits."""
    names = F.transform("columns", lambda c: c["name"])
    kind = None
    for category, column in rules:
        has = F.array_contains(names, column)
        kind = F.when(has, category) if kind is None else kind.when(has, category)
    return meta.select("filename", F.coalesce(kind, F.lit("exception")).alias("category"))


def category_counts(categories: DataFrame) -> DataFrame:
    return categories.groupBy("category").agg(F.count("*").alias("files"))
