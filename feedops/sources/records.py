"""Records and cells of delimited text by quote state.

A quote opens a cell only at the cell's start and counts as text elsewhere (``5" pipe``). Inside a quoted cell a doubled quote is
one quote, and separators and line breaks are text. The closing quote ends the cell at the next separator; what stands between
(``"a"b``) keeps the whole cell as it is. A quote that is never closed takes the rest of its record. These are the rules by which
Spark's CSV reader cuts one line, so counts of cells by ``cells`` are what that reader makes of a line.

``records`` puts lines together where quoted cells span them, without giving a file to one task. Every line either leaves the
quote state as it is, flips it, or sets it; such steps compose, so each split of a file is summed up by one step, the steps
of a file's splits (one row per split) give the state at the start of each, and lines are numbered inside their split.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedops.session import durable
from feedops.sources.inventory import decoded

_END = r"(?![\s\S])"


def _parts(sep: str, quote: str) -> tuple[str, str, str, str]:
    """Patterns: separator, quote, inside of a quoted cell, rest of an unquoted one."""
    s, q = re.escape(sep), re.escape(quote)
    return s, q, f"[^{q}]*+(?:{q}{q}[^{q}]*+)*+", f"[^{s}]*+"


def cell_pattern(sep: str, quote: str) -> str:
    """A separator and the cell after it; for texts that begin with a separator."""
    s, q, body, plain = _parts(sep, quote)
    return f"{s}({q}{body}(?:{q}{plain})?+|{plain})"


def cells(record: Column, sep: str = ",", quote: str = '"') -> Column:
    """The cells of a record as they stand in it, quotes included."""
    return F.regexp_extract_all(F.concat(F.lit(sep), record), F.lit(cell_pattern(sep, quote)), F.lit(1))


def _value_pattern(quote: str) -> str:
    _, q, body, _ = _parts(",", quote)
    return rf"^{q}({body}){q}?+[ \t\r]*+{_END}"


def cell_value(cell: Column, quote: str = '"') -> Column:
    """Text of a cell: NULL if it is empty and unquoted, without its quotes if it is quoted."""
    inner = F.regexp_extract(cell, _value_pattern(quote), 1)
    quoted = cell.startswith(quote) & (F.length(cell) > 1) & cell.rlike(_value_pattern(quote))
    return F.when(quoted, F.replace(inner, F.lit(quote * 2), F.lit(quote))).when(cell != "", cell)


def split_record(record: str, sep: str = ",", quote: str = '"') -> list[str]:
    """``cells`` and ``cell_value`` for one record on the driver; an empty cell is empty text."""
    out = []
    for cell in re.findall(cell_pattern(sep, quote), sep + record):
        found = re.match(_value_pattern(quote), cell) if len(cell) > 1 else None
        out.append(found.group(1).replace(quote * 2, quote) if found else cell)
    return out


def well_quoted(record: Column, sep: str, quote: str) -> Column:
    """Whether a record has a quoted cell that ends at a separator or at its end."""
    s, q, body, _ = _parts(sep, quote)
    return F.concat(F.lit(sep), record).rlike(f"{s}{q}{body}{q}(?:{s}|{_END})")


def _steps(line: Column, sep: str, quote: str) -> tuple[Column, Column]:
    """Whether a cell is open after a line: if none was before it, and if one was."""
    s, q, body, plain = _parts(sep, quote)
    whole = f"(?:{s}(?:{q}{body}{q}{plain}|(?!{q}){plain}))*+"
    opened = f"{whole}{s}{q}{body}{_END}"
    has = line.contains(quote)
    return has & F.concat(F.lit(sep), line).rlike(f"^{opened}"), ~has | line.rlike(f"^{body}(?:{_END}|{q}{plain}{opened})")


def lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``path, at, line`` of all files behind ``paths``, blank lines left out; ``at`` orders the lines of a file."""
    found = spark.read.option("recursiveFileLookup", True).text(list(paths))
    return found.select(
        decoded(F.col("_metadata.file_path")).alias("path"),
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).alias("at"),
        F.col("value").alias("line"),
    ).filter(F.trim("line") != "")


def _after(before: Column, flips: Column, at_set: Column, value: Column) -> Column:
    """State after steps: that before them or the last one set, flipped as often as there were flips since."""
    return F.coalesce(value, before) != ((flips - F.coalesce(at_set, F.lit(0))) % 2 == 1)


def _composed(steps: DataFrame, within: Sequence[str], order: str) -> DataFrame:
    """Steps (``set`` boolean or NULL, ``flip`` 0 or 1) of each group composed up to each row: ``flips, at_set, value``."""
    up_to = Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = steps.withColumn("flips", F.sum("flip").over(up_to))
    last = F.last(F.when(F.col("set").isNotNull(), F.struct("set", "flips")), ignorenulls=True).over(up_to)
    return counted.withColumn("__last", last).withColumns({"at_set": F.col("__last.flips"), "value": F.col("__last.set")}).drop("__last")


def records(spark: SparkSession, paths: Sequence[str], sep: str = ",", quote: str = '"') -> DataFrame:
    """As ``lines``, but for records: a quoted cell may span lines. Blank lines between records are left out.

    Lines end with ``\\n``; a ``\\r`` before it belongs to the end of a record, and inside a quoted cell to its text.
    """
    text = spark.read.option("recursiveFileLookup", True).option("lineSep", "\n").text(list(paths))
    opens, stays = _steps(F.col("value"), sep, quote)
    # written once: three steps below need the same numbers
    tagged = durable(text.select(
        decoded(F.col("_metadata.file_path")).alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"), F.col("value").alias("text"), opens.alias("opens"), stays.alias("stays"),
    ))
    split = ["path", "block"]
    steps = tagged.select(
        *split, "line", F.when(F.col("opens") == F.col("stays"), F.col("opens")).alias("set"),
        (F.col("opens") & ~F.col("stays")).cast("int").alias("flip"),
    )
    inside = _composed(steps, split, "line")
    in_order = Window.partitionBy(*split).orderBy("line")
    # one step per split, and the state in which each split begins
    whole = inside.groupBy(*split).agg(
        F.max_by(F.struct("flips", "at_set", "value"), "line").alias("s")
    ).select(*split, F.col("s.value").alias("set0"), "s.flips", "s.at_set")
    whole = whole.select(
        *split, F.when(F.col("set0").isNotNull(), _after(F.lit(False), F.col("flips"), F.col("at_set"), F.col("set0"))).alias("set"),
        F.when(F.col("set0").isNull(), F.col("flips") % 2).otherwise(0).alias("flip"),
    )
    by_file = Window.partitionBy("path").orderBy("block")
    end = _after(F.lit(False), F.col("flips"), F.col("at_set"), F.col("value"))
    starts = _composed(whole, ["path"], "block").select(*split, F.coalesce(F.lag(end).over(by_file), F.lit(False)).alias("begin"))
    state = _after(F.col("begin"), F.col("flips"), F.col("at_set"), F.col("value"))
    begun = inside.join(starts, split).withColumn("open", F.coalesce(F.lag(state).over(in_order), F.col("begin")))
    begun = begun.select(*split, "line", F.when(~F.col("open"), F.struct("block", "line")).alias("at"))
    # the record that is still open when a split begins started in an earlier one
    earlier = by_file.rowsBetween(Window.unboundedPreceding, -1)
    carried = begun.groupBy(*split).agg(F.max("at").alias("at")).select(*split, F.last("at", ignorenulls=True).over(earlier).alias("carried"))
    up_to = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    owner = begun.withColumn("at", F.last("at", ignorenulls=True).over(up_to)).join(carried, split)
    owner = owner.select(*split, "line", F.coalesce("at", "carried").alias("at"))
    pieces = tagged.select(*split, "line", "text").join(owner, [*split, "line"])
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "line", "text"))), lambda p: p["text"]), "\n")
    made = pieces.groupBy("path", "at").agg(joined.alias("line"))
    return made.select("path", "at", F.regexp_replace("line", "\r$", "").alias("line")).filter(F.trim(F.translate("line", "\r\n", "")) != "")
