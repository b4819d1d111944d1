"""Ad-hoc queries: select, filter, page, sample, look up."""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedops.plans.columns import col, require_columns
from feedops.plans.ranked import before, between, numbered, range_bounds

# Rows a top-n keeps per task and gathers in one; deeper pages are found by counting ranges.
SHALLOW = 1_000


def select_cols(df: DataFrame, columns: Sequence[str] | str) -> DataFrame:
    """Named columns; unknown names are an error that lists them."""
    names = [c.strip() for c in columns.split(",")] if isinstance(columns, str) else list(columns)
    return df.select(*[col(c) for c in require_columns(df, names)])


def parse_terms(text: str) -> list[tuple[str, str]]:
    """``c1:v1,c2:v2`` as pairs; a term without a colon is reported and skipped."""
    pairs = []
    for term in (t.strip() for t in text.split(",")):
        name, colon, value = term.partition(":")
        if colon:
            pairs.append((name, value))
        else:
            warnings.warn(f"term without a colon skipped: {term}", stacklevel=3)
    return pairs


def _equals(df: DataFrame, name: str, value: object) -> Column:
    kind = df.schema[name].dataType
    if value is None:
        return F.lit(False)
    if isinstance(value, str) and not isinstance(kind, T.StringType):
        return col(name) == F.lit(value).try_cast(kind)
    return col(name) == F.lit(value)


def where_eq(df: DataFrame, terms: Mapping[str, object] | str) -> DataFrame:
    """AND of ``column = value``; the value takes the column's type, so the test
    reaches the scan. Unknown columns are reported and skipped."""
    pairs = parse_terms(terms) if isinstance(terms, str) else list(terms.items())
    tests = []
    for name, value in pairs:
        if name in df.columns:
            tests.append(_equals(df, name, value))
        else:
            warnings.warn(f"term on an unknown column skipped: {name}", stacklevel=2)
    return df.filter(reduce(lambda a, b: a & b, tests)) if tests else df


def rows_at(
    df: DataFrame, start: int, count: int, order_by: Sequence[str], shallow: int = SHALLOW
) -> DataFrame:
    """Rows ``start`` to ``start + count - 1`` of a total order, 0-based.

    Near the start a top-n is enough. Beyond ``shallow`` rows it would gather
    the skipped rows in one task, so the bounds of the range come first.
    Only the order columns are shuffled to find the bounds (this runs jobs);
    the rows are then read by a range filter and numbered, so that ties at a
    bound add no row. Which of equal rows are returned is not defined.
    """
    if start + count <= shallow:
        return df.orderBy(*[col(c) for c in order_by]).offset(start).limit(count)
    found = range_bounds(df, order_by, start, count)
    if found is None:
        return df.limit(0)
    inside = between(order_by, *found)
    sizes = df.agg(F.count_if(before(order_by, found[0])).alias("before"), F.count_if(inside).alias("inside")).first()
    kept, skipped = df.filter(inside), start - sizes["before"]
    if skipped or sizes["inside"] > count:  # ties at a bound
        kept = numbered(kept, order_by, "__n").filter(F.col("__n").between(skipped + 1, skipped + count)).drop("__n")
    return kept.orderBy(*[col(c) for c in order_by])


def page(
    df: DataFrame, order_by: Sequence[str], limit: int = 100, offset: int = 0, most: int | None = None
) -> DataFrame:
    """One page of an order; ``most`` refuses larger pages, as a server would."""
    if limit < 1 or most is not None and limit > most:
        raise ValueError("limit must be at least 1" if limit < 1 else f"limit must be between 1 and {most}")
    if offset < 0:
        raise ValueError("offset must not be negative")
    return rows_at(df, offset, limit, order_by)


def query(
    df: DataFrame,
    order_by: Sequence[str],
    columns: Sequence[str] | str | None = None,
    filters: Mapping[str, object] | str | None = None,
    limit: int = 100,
    offset: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """(page, total): filter, then page, then select; total counts the filtered rows."""
    names = df.columns if columns is None else select_cols(df, columns).columns
    kept = where_eq(df, filters) if filters else df
    rows = page(kept, order_by, limit, offset)
    return select_cols(rows, names), kept.agg(F.count("*").alias("total"))


def where_any_eq(df: DataFrame, columns: Sequence[str], value: object) -> DataFrame:
    """Rows where any of the columns has the value."""
    names = require_columns(df, columns)
    return df.filter(reduce(lambda a, b: a | b, [_equals(df, c, value) for c in names]))


def account_columns(original: Sequence[str], current: Sequence[str], name: str = "Account") -> list[str]:
    """Current names of every column whose header was ``name``."""
    return [c for o, c in zip(original, current) if o == name]


def head(df: DataFrame, n: int = 10) -> DataFrame:
    """First rows, in no promised order."""
    return df.limit(n)


def sample(df: DataFrame, frac: float, seed: int = 0) -> DataFrame:
    """Random fraction without replacement."""
    return df.sample(withReplacement=False, fraction=frac, seed=seed)


def attribute(records: DataFrame, name: str, data: str = "data") -> Column:
    """One attribute of a record, from a map or a JSON text."""
    if isinstance(records.schema[data].dataType, T.MapType):
        return F.try_element_at(col(data), F.lit(name))
    return F.get_json_object(col(data), f"$.{name}")


def find_by_attr(
    records: DataFrame, terms: Mapping[str, str | None], any_of: bool = False, data: str = "data"
) -> DataFrame:
    """Records by attribute values, all or ``any_of`` them; a value of None asks
    only that the attribute is there."""
    tests = [
        attribute(records, k, data).isNotNull() if v is None else attribute(records, k, data) == F.lit(v)
        for k, v in terms.items()
    ]
    return records.filter(reduce((lambda a, b: a | b) if any_of else (lambda a, b: a & b), tests))


def attrs(records: DataFrame, names: Mapping[str, str], key: str = "id", data: str = "data") -> DataFrame:
    """The key and the attributes as columns: ``{alias: attribute}``."""
    return records.select(col(key), *[attribute(records, n, data).alias(a) for a, n in names.items()])


def sql(
    spark: SparkSession, text: str, tables: Mapping[str, DataFrame] | None = None, args: Mapping | Sequence | None = None
) -> DataFrame:
    """Any Spark SQL over registered tables; literals are bound as parameters."""
    for name, df in (tables or {}).items():
        df.createOrReplaceTempView(name)
    return spark.sql(text, args=args)


def describe_table(df: DataFrame) -> DataFrame:
    """``position, name, type, row_count, column_count``; the count is one scan."""
    listed = F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(n).alias("name"), F.lit(t).alias("type")) for i, (n, t) in enumerate(df.dtypes)
    ])
    counted = df.agg(F.count("*").alias("row_count")).withColumn("c", F.explode(listed))
    return counted.select("c.*", "row_count", F.lit(len(df.columns)).alias("column_count"))


def where(df: DataFrame, condition: str | Column) -> DataFrame:
    """Rows that satisfy an expression such as ``price > 100``."""
    return df.filter(condition)
