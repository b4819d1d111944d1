"""Joins over a table catalog, key reduction and missing-key checks.

No side is marked for broadcast: Spark broadcasts a side only when its measured
size is under ``spark.sql.autoBroadcastJoinThreshold``, at plan time or, with
AQE, at run time. Hot keys of larger joins are split by ``spread_join``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedops.operators.query import _equals
from feedops.plans.columns import col, require_columns, resolve_key

Catalog = Mapping[str, DataFrame]
# (left table, left column, right table, right column)
JoinKey = tuple[str, str, str, str]


def require_tables(catalog: Catalog, names: Sequence[str]) -> None:
    missing = [n for n in names if n not in catalog]
    if missing:
        raise ValueError(f"tables missing from the catalog: {', '.join(missing)}")


def _placed(df: DataFrame) -> DataFrame:
    """Adds ``__place``, a number that a row keeps however often and wherever it is read."""
    try:
        return df.select("*", F.col("_metadata.row_index").alias("__place"))
    except AnalysisException:  # no scan, or a format that does not number its rows
        maps = {f.name for f in df.schema if isinstance(f.dataType, T.MapType)}
        return df.withColumn("__place", F.xxhash64(*[F.to_json(col(c)) if c in maps else col(c) for c in df.columns]))


def spread_join(left: DataFrame, right: DataFrame, key: str, slices: int = 16) -> DataFrame:
    """Inner join on one column in which a hot key of ``left`` is cut into slices.

    A key is hot when it holds more than 1/(4 * slices) of the left rows, so
    there are fewer than ``4 * slices`` hot keys and their list has a fixed
    bound. Left rows of a hot key get one of ``slices`` numbers that is the same
    whenever they are read again: by their place in a parquet file where the frame
    is a scan of one, so equal rows spread too and no column is read for it, else by a
    hash of the row. The right rows of the hot keys alone are copied once per number.
    """
    present = _placed(left).filter(col(key).isNotNull())
    counts = present.groupBy(col(key).alias("__k")).agg(F.count("*").alias("__n"))
    total = counts.agg(F.sum("__n")).scalar()
    hot = counts.filter(F.col("__n") * (4 * slices) > total).select("__k", F.lit(True).alias("__hot"))
    salt = F.pmod(F.col("__place"), F.lit(slices)).cast("int")
    marked = present.join(F.broadcast(hot), col(key) == F.col("__k"), "left")
    marked = marked.withColumn("__slice", F.when(F.col("__hot"), salt).otherwise(0)).drop("__k", "__hot", "__place")
    copies = right.join(F.broadcast(hot), col(key) == F.col("__k"), "left")
    copies = copies.withColumn(
        "__slice",
        F.explode(F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(slices - 1))).otherwise(F.array(F.lit(0)))),
    ).drop("__k", "__hot")
    return marked.join(copies, [key, "__slice"]).drop("__slice")


def _prefixed(df: DataFrame, table: str, taken: Sequence[str]) -> DataFrame:
    """Columns whose names are taken get the table name in front."""
    used = {t.lower() for t in taken}
    return df.select(*[col(c).alias(f"{table}_{c}" if c.lower() in used else c) for c in df.columns])


def join_tables(
    catalog: Catalog, tables: Sequence[str], on: Sequence[JoinKey], slices: int | None = None
) -> DataFrame:
    """Inner equi-join of the tables in the given order, all columns kept.

    Clashing column names get the table name in front. Both key columns stay.
    ``slices`` cuts hot keys of single-column joins apart (``spread_join``).
    """
    require_tables(catalog, tables)
    out = catalog[tables[0]]
    names = {(tables[0], c): c for c in out.columns}
    for table in tables[1:]:
        right = _prefixed(catalog[table], table, out.columns)
        names.update({(table, c): n for c, n in zip(catalog[table].columns, right.columns)})
        pairs = []
        for lt, lc, rt, rc in on:
            if rt == table and (lt, lc) in names:
                pairs.append((names[lt, lc], names[table, rc]))
            elif lt == table and (rt, rc) in names:
                pairs.append((names[rt, rc], names[table, lc]))
        if not pairs:
            raise ValueError(f"no join condition for table {table}")
        if slices and len(pairs) == 1:
            have, want = pairs[0]
            out = spread_join(out, right.withColumnRenamed(want, have), have, slices).withColumn(want, col(have))
        else:
            out = out.join(right, reduce(lambda a, b: a & b, [col(h) == col(w) for h, w in pairs]))
    return out


def filter_shared(catalog: Catalog, tables: Sequence[str], terms: Mapping[str, object]) -> dict[str, DataFrame]:
    """Each table filtered by every term whose column it has, in any letter case."""
    require_tables(catalog, tables)
    out = {}
    for table in tables:
        df = catalog[table]
        known = {c.lower(): c for c in df.columns}
        for name, value in terms.items():
            if name.lower() in known:
                df = df.filter(_equals(df, known[name.lower()], value))
        out[table] = df
    return out


def semi_reduce(small: DataFrame, big: DataFrame, on: str | tuple[str, str]) -> DataFrame:
    """Rows of ``big`` whose key occurs in ``small``; every key counts."""
    left, right = (on, on) if isinstance(on, str) else on
    keys = small.select(col(left).alias("__k")).filter(F.col("__k").isNotNull()).distinct()
    return big.join(keys, col(right) == F.col("__k"), "left_semi")


def join_limited(
    catalog: Catalog, tables: Sequence[str], on: Sequence[JoinKey], n: int, order_by: Sequence[str]
) -> DataFrame:
    """Join in which the limit applies to the first table before the join."""
    require_tables(catalog, tables)
    driving = catalog[tables[0]].orderBy(*[col(c) for c in order_by]).limit(n)
    return join_tables({**catalog, tables[0]: driving}, tables, on)


def _keys(df: DataFrame, key: str) -> DataFrame:
    return df.select(col(resolve_key(df, key)).alias("key")).filter(F.col("key").isNotNull())


def missing_keys(staged: DataFrame, master: DataFrame, key: str, master_key: str | None = None) -> DataFrame:
    """Distinct staged keys the master does not have."""
    absent = _keys(staged, key).distinct().join(_keys(master, master_key or key), "key", "left_anti")
    return absent.select(F.col("key").alias(key))


def missing_summary(
    staged: Mapping[str, DataFrame], master: DataFrame, key: str, master_key: str | None = None
) -> DataFrame:
    """``table_name, missing`` for every staged table, one pass over the master."""
    tagged = [_keys(df, key).distinct().withColumn("table_name", F.lit(name)) for name, df in staged.items()]
    every = reduce(DataFrame.unionByName, tagged)
    names = master.sparkSession.createDataFrame([(n,) for n in staged], "table_name string")
    absent = every.join(_keys(master, master_key or key), "key", "left_anti")
    counts = absent.groupBy("table_name").agg(F.count("*").alias("missing"))
    return names.join(counts, "table_name", "left").select("table_name", F.coalesce("missing", F.lit(0)).alias("missing"))


def merged_rows(master: DataFrame, staged: DataFrame, key: str, master_key: str | None = None) -> DataFrame:
    """Master rows whose key is in the staged file."""
    require_columns(staged, [key])
    return semi_reduce(staged, master, (key, master_key or key))
