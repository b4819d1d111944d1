"""Reading CSV feeds as text, with the header rules of vendor files."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedops.functions.values import name_date_text
from feedops.plans.columns import col
from feedops.plans.ranked import nth_values, numbered
from feedops.session import durable
from feedops.sources.inventory import base_name, decoded, logical_path, require_nonempty
from feedops.sources.records import cell_value, cells, lines, records, split_record, well_quoted

# A text no feed holds: with it as the null text, an empty cell is NULL and a
# quoted empty cell ("") is empty text.
UNSEEN = "\x00"
SEPARATORS = [",", ";", "\t", "|"]
QUOTES = ['"', "'"]
#: Rows per file up to which each map task may send its own first rows to the ranking.
RANKED = 1000


def dedupe_header(names: Sequence[str]) -> list[str]:
    """A repeated name gets its zero-based position appended, the first keeps it.

    Names that differ in case only count as repeated, since Spark would not tell them apart.
    """
    seen: set[str] = set()
    out = []
    for position, name in enumerate(names):
        out.append(f"{name}_{position}" if name.lower() in seen else name)
        seen.add(name.lower())
    return out


def extend_header(names: Sequence[str], probe: Sequence[Sequence[str]]) -> list[str]:
    """Names for the cells that the probed rows have beyond the header."""
    widest = max([len(names), *[len(row) for row in probe]])
    return [*names, *[f"column_{i + 1}" for i in range(len(names), widest)]]


def column_mapping(spark: SparkSession, original: Sequence[str]) -> DataFrame:
    """``position, original_name, current_name, renamed`` of a header."""
    rows = [(i, o, c, o != c) for i, (o, c) in enumerate(zip(original, dedupe_header(original)))]
    return spark.createDataFrame(
        rows, "position int, original_name string, current_name string, renamed boolean"
    )


def head_lines(spark: SparkSession, path: str, n: int = 6) -> list[str]:
    """First lines of one file; the job stops after its first block."""
    return [r[0] for r in spark.read.option("recursiveFileLookup", True).text(path).limit(n).collect()]


def _rows(spark: SparkSession, paths: Sequence[str], sep: str, quote: str, multi_line: bool) -> DataFrame:
    """``path, at, line``: the lines of all files, or the records where cells may span lines."""
    return records(spark, paths, sep, quote) if multi_line else lines(spark, paths)


def _head_facts(rows: DataFrame, candidates: Sequence[tuple[str, str]]) -> DataFrame:
    """One row per file: its first line, the widest row by each (separator, quote), and if there are several, how well they fit."""
    facts = []
    for i, (s, q) in enumerate(candidates):
        width = F.size(cells(F.col("line"), s, q))
        # the set of widths has a task keep one entry per file; for a largest width beside a first line Spark would sort all lines
        facts.append(F.array_max(F.collect_set(width)).alias(f"most{i}"))
        if len(candidates) > 1:
            facts += [
                F.min_by(width, "at").alias(f"head{i}"), F.mode(width).alias(f"mode{i}"), F.var_pop(width).alias(f"spread{i}"),
                F.count_if(well_quoted(F.col("line"), s, q)).alias(f"quoted{i}"),
            ]
    return rows.groupBy("path").agg(F.min_by("line", "at").alias("head"), *facts)


def headers_by_path(
    spark: SparkSession, paths: Sequence[str], sep: str = ",", quote: str = '"', rows: DataFrame | None = None
) -> dict[tuple[tuple[str, ...], str, str], list[str]]:
    """The files behind ``paths`` (files, folders, globs) grouped by (header, separator, quote).

    One job over all files gives the first line and the widest row of each, so no row has a cell without a name and no
    file is read by the header of another. With ``"auto"`` the separator and the quote of a file are those whose cells fit
    it best: rows as wide as the header, all of one width, more quoted cells that end where a cell ends. Files without a
    line are left out. The driver holds one line per file. ``rows`` (``path, at, line``) stands in for the lines.
    """
    candidates = [(s, q) for s in (SEPARATORS if sep == "auto" else [sep]) for q in (QUOTES if quote == "auto" else [quote])]
    choose = len(candidates) > 1
    heads = _head_facts(rows if rows is not None else lines(spark, paths), candidates)
    groups: dict[tuple[tuple[str, ...], str, str], list[str]] = defaultdict(list)
    for row in sorted(heads.toLocalIterator(), key=lambda r: r["path"]):
        def fit(i: int) -> tuple:
            wide = row[f"head{i}"]
            return wide > 1 and wide == row[f"mode{i}"], -row[f"spread{i}"], row[f"quoted{i}"], wide, -i

        best = max(range(len(candidates)), key=fit) if choose else 0
        used = candidates[best]
        names = extend_header(split_record(row["head"].rstrip("\r"), *used), [[""] * row[f"most{best}"]])
        groups[(tuple(dedupe_header(names)), *used)].append(row["path"])
    return dict(groups)


def _counted(rows: DataFrame) -> DataFrame:
    """``path, block, cells, n, line`` of rows with ``cells``: how many rows of a split have so many cells, and the first of them.

    Numbers only, so every map task counts into a hash table and a file moves as one row per split and number of cells.
    """
    return rows.groupBy("path", F.col("at.block").alias("block"), "cells").agg(
        F.count("*").alias("n"), F.min("at.line").alias("line")
    )


def _first_rows(rows: DataFrame) -> DataFrame:
    """``path, first``: where the first row of every file stands; the first of each split is found among numbers, without a sort."""
    first = rows.groupBy("path", F.col("at.block").alias("block")).agg(F.min("at.line").alias("line"))
    return first.groupBy("path").agg(F.min(F.struct("block", "line")).alias("first"))


def _with_cells(spark: SparkSession, paths: str | Sequence[str], sep: str, quote: str, multi_line: bool) -> DataFrame:
    """``path, at, line, cells``: the rows and how many cells they have."""
    found = _rows(spark, [paths] if isinstance(paths, str) else paths, sep, quote, multi_line)
    return found.withColumn("cells", F.size(cells(F.col("line"), sep, quote)))


def misfits(
    spark: SparkSession, paths: str | Sequence[str], sep: str = ",", quote: str = '"', multi_line: bool = False
) -> DataFrame:
    """``path, rows, short_rows, long_rows``: rows with fewer or more cells than the header of their file.

    One pass: rows are counted by their cells first, and the counts held against the header, which is as wide as itself.
    """
    width = F.min_by("cells", F.struct("block", "line")).over(Window.partitionBy("path"))
    judged = _counted(_with_cells(spark, paths, sep, quote, multi_line)).withColumn("width", width)
    return judged.groupBy("path").agg(
        (F.sum("n") - 1).alias("rows"), F.sum(F.when(F.col("cells") < F.col("width"), F.col("n")).otherwise(0)).alias("short_rows"),
        F.sum(F.when(F.col("cells") > F.col("width"), F.col("n")).otherwise(0)).alias("long_rows"),
    )


def quarantine(
    spark: SparkSession, paths: str | Sequence[str], sep: str = ",", quote: str = '"', multi_line: bool = False
) -> DataFrame:
    """``path, at, cells, width, line``: the rows that ``misfits`` counts, as they stand in their file.

    The widths, one row per file, are written first: with a known size they are sent to the rows, which then need no shuffle.
    """
    rows = _with_cells(spark, paths, sep, quote, multi_line)
    widths = durable(_counted(rows).groupBy("path").agg(F.min_by("cells", F.struct("block", "line")).alias("width")))
    return rows.join(widths, "path").filter(F.col("cells") != F.col("width")).select("path", "at", "cells", "width", "line")


def _grouped(spark: SparkSession, paths: Sequence[str], sep: str, quote: str, rows: DataFrame | None = None):
    if not paths:
        raise ValueError("no files to read")
    groups = headers_by_path(spark, paths, sep, quote, rows)
    if not groups:
        raise ValueError(f"no header line in {', '.join(paths)}")
    return groups.items()


def _from_records(spark: SparkSession, paths: Sequence[str], sep: str, quote: str) -> list[DataFrame]:
    """One frame per distinct header of files whose cells may span lines, with ``__path`` and ``__at``."""
    if "auto" in (sep, quote):
        raise ValueError("cells that span lines need a known separator and quote")
    rows = durable(records(spark, paths, sep, quote))
    found = _grouped(spark, paths, sep, quote, rows)
    first = _first_rows(rows)
    known = spark.createDataFrame([(p, g) for g, (_, files) in enumerate(found) for p in files], "path string, header int")
    below = rows.join(first.join(known, "path"), "path").filter(F.col("at") != F.col("first"))
    out = []
    for g, ((names, *_), _files) in enumerate(found):
        own = below.filter(F.col("header") == g).select(F.col("path").alias("__path"), F.col("at").alias("__at"), cells(F.col("line"), sep, quote).alias("__cells"))
        out.append(own.select("__path", "__at", *[cell_value(F.get("__cells", F.lit(i)), quote).alias(n) for i, n in enumerate(names)]))
    return out


def _read(spark: SparkSession, paths: Sequence[str], names: Sequence[str], sep: str, quote: str):
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return (
        spark.read.schema(schema)
        .option("header", True).option("sep", sep).option("quote", quote).option("escape", quote)
        .option("nullValue", UNSEEN)
        .csv(list(paths))
    )


def read_text_csv(
    spark: SparkSession, paths: str | Sequence[str], sep: str = ",", quote: str = '"', multi_line: bool = False
) -> DataFrame:
    """Every column as text under its exact header name; an empty cell is NULL, a
    quoted empty cell is empty text.

    ``paths`` may hold globs and folders. Every file is read by its own header:
    one scan per distinct header, and the columns a file lacks are NULL. Cells
    beyond the header are columns of their own. ``sep`` and ``quote`` may be
    ``"auto"``. ``multi_line``: quoted cells may span lines; the records are put
    together and written first (see ``sources.records``).
    """
    listed = [paths] if isinstance(paths, str) else list(dict.fromkeys(paths))
    if multi_line:
        frames = [f.drop("__path", "__at") for f in _from_records(spark, listed, sep, quote)]
    else:
        frames = [_read(spark, group, names, *used) for (names, *used), group in _grouped(spark, listed, sep, quote)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_inferred_csv(spark: SparkSession, paths: str | Sequence[str], sep: str = ",", quote: str = '"') -> DataFrame:
    """Column types inferred from every row, not from a sample."""
    listed = [paths] if isinstance(paths, str) else list(paths)
    return (
        spark.read.option("header", True).option("sep", sep).option("quote", quote).option("escape", quote)
        .option("inferSchema", True).option("samplingRatio", 1.0)
        .csv(listed)
    )


def with_file(df: DataFrame, out: str = "_file") -> DataFrame:
    """Adds the file a row was read from (a folder of part files is one file)."""
    return df.withColumn(out, logical_path(decoded(F.col("_metadata.file_path"))))


def with_row_order(df: DataFrame, out: str = "_row") -> DataFrame:
    """Adds a value that orders the rows of one file as they stand in it.

    Split offset first: the id alone would follow the order in which Spark
    packed the splits.
    """
    return df.withColumn(
        out,
        F.struct(
            F.col("_metadata.file_name").alias("part"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("line"),
        ),
    )


def with_clock(df: DataFrame, out: str = "_read_at") -> DataFrame:
    """Adds when a row was read: the task and its clock in nanoseconds. For frames that still stand at their scan."""
    clock = F.reflect(F.lit("java.lang.System"), F.lit("nanoTime")).cast("bigint")
    return df.withColumn(out, F.struct(F.spark_partition_id().alias("task"), clock.alias("nanos")))


def read_feed(
    spark: SparkSession, files: str | Sequence[str] | DataFrame, sep: str = ",", quote: str = '"', spread: bool = True,
    row_order: bool = False, clock: bool = False, multi_line: bool = False, heads: Mapping[tuple, Sequence[str]] | None = None,
) -> DataFrame:
    """Text feed with ``_file`` and ``_source_date`` (the date in the file name).

    ``files``: paths, or an inventory. ``row_order`` adds ``_row``, which orders the
    rows of a file; ``clock`` adds ``_read_at`` for measured load runs. A gz file is
    read by one task, so its rows are spread before further work. ``heads`` are the
    files by header (``headers_by_path``), where the caller has them already.
    """
    if isinstance(files, DataFrame):
        files = [r["path"] for r in files.select("path").toLocalIterator()]
    listed = [files] if isinstance(files, str) else list(dict.fromkeys(files))
    frames = []
    if multi_line:
        for tagged in _from_records(spark, listed, sep, quote):
            tagged = tagged.withColumn("_file", logical_path(F.col("__path")))
            if row_order:
                tagged = tagged.withColumn("_row", F.struct(base_name(F.col("__path")).alias("part"), F.col("__at.block"), F.col("__at.line")))
            frames.append(tagged.drop("__path", "__at"))
    else:
        for (names, *used), group in heads.items() if heads else _grouped(spark, listed, sep, quote):
            tagged = with_file(_read(spark, group, names, *used))
            frames.append(with_row_order(tagged) if row_order else tagged)
    frames = [f.withColumn("_source_date", name_date_text(base_name(F.col("_file")))) for f in frames]
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [with_clock(f) for f in frames] if clock else frames)
    return out.hint("rebalance") if spread and any(p.rstrip("/").endswith(".gz") for p in listed) else out


def require_rows(
    spark: SparkSession, inv: DataFrame, sep: str = ",", quote: str = '"', multi_line: bool = False
) -> DataFrame:
    """Inventory with ``ok``, ``error`` and ``row_count``: a file needs bytes, a header line and a row below it.

    One job over the files counts their rows; a folder of part files is one file, each part with its own header.
    """
    checked = require_nonempty(inv).withColumn("__file", logical_path(F.col("path")))
    paths = [r["path"] for r in inv.filter(F.col("size") > 0).select("path").toLocalIterator()]
    if not paths:
        return checked.drop("__file").withColumn("row_count", F.lit(0).cast("bigint"))
    per_part = _rows(spark, paths, sep, quote, multi_line).groupBy("path").agg((F.count("*") - 1).alias("below"))
    counted = per_part.groupBy(logical_path(F.col("path")).alias("__file")).agg(F.sum("below").alias("row_count"))
    problem = F.when(F.col("row_count").isNull(), "no header line in ").when(F.col("row_count") == 0, "no rows in ")
    found = checked.join(counted, "__file", "left").withColumn("error", F.coalesce("error", F.concat(problem, F.col("path"))))
    return found.select(*inv.columns, F.col("error").isNull().alias("ok"), "error", F.coalesce("row_count", F.lit(0)).alias("row_count"))


def limit_per_file(
    df: DataFrame, n: int, order_by: Sequence[str], file_col: str = "_file", ranked: int = RANKED
) -> DataFrame:
    """First ``n`` rows of every file, exactly.

    Up to ``ranked`` rows the ranking is cut off inside each map task, which sends at most so many rows per file. Beyond that the
    order value of each file's ``n``-th row is looked up among the order columns alone, and rows are held against it: they are not
    ranked, rewritten or gathered per file. Among rows that tie with that value as many are kept as still fit.
    """
    if n <= ranked:
        w = Window.partitionBy(file_col).orderBy(*[col(c) for c in order_by])
        return df.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= n).drop("__n")
    here = F.struct(*[col(c).alias(f"o{i}") for i, c in enumerate(order_by)])
    cuts = durable(nth_values(df, n, order_by, file_col))
    cuts = cuts.select(F.col("__group").alias("__cut_group"), F.col("__value").alias("__cut"), F.col("__room").alias("__cut_room"), "__ties")
    held = df.join(cuts, col(file_col).eqNullSafe(F.col("__cut_group")), "left")
    # no cut: a file of fewer rows
    sure = F.col("__cut").isNull() | (here < F.col("__cut")) | ((here == F.col("__cut")) & (F.col("__ties") <= F.col("__cut_room")))
    if cuts.filter("__ties > __cut_room").isEmpty():
        return held.filter(sure).select(*[col(c) for c in df.columns])
    tied = durable(held.filter((here == F.col("__cut")) & (F.col("__ties") > F.col("__cut_room"))).withColumn("__id", F.monotonically_increasing_id()))
    fitting = numbered(tied, ["__id"], "__n", [file_col]).filter(F.col("__n") <= F.col("__cut_room"))
    return held.filter(sure).select(*[col(c) for c in df.columns]).unionByName(fitting.select(*[col(c) for c in df.columns]))


def reconcile_counts(df: DataFrame, meta: DataFrame, file_col: str = "_file") -> DataFrame:
    """Declared and actual rows per file, and the percentage loaded.

    ``meta`` has ``filename`` and ``rowCount``; files it does not list count as
    declared 0, and listed files without rows as loaded 0.
    """
    actual = df.groupBy(F.col(file_col).alias("filename")).agg(F.count("*").alias("actual_rows"))
    declared = meta.select("filename", F.col("rowCount").cast("bigint").alias("declared_rows"))
    joined = declared.join(actual, "filename", "full_outer").select(
        "filename",
        F.coalesce("declared_rows", F.lit(0)).alias("declared_rows"),
        F.coalesce("actual_rows", F.lit(0)).alias("actual_rows"),
    )
    share = F.floor(F.col("actual_rows") * 100 / F.col("declared_rows"))
    return joined.withColumn("percent", F.when(F.col("declared_rows") > 0, share).cast("bigint")).withColumn(
        "complete", F.col("declared_rows") == F.col("actual_rows")
    )
