"""Sinks, each written and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedops.operators.diff import cell_changes, changed_columns, diff_stats
from feedops.operators.merge import upsert_records
from feedops.registry.base import Registry, table
from feedops.registry.diffs import KEY, _stats
from feedops.registry.inputs import CELLS, TEXT_ORDERS, snapshots, text_orders
from feedops.registry.merging import ORDER, _long, staged_orders, target_records
from feedops.session import scratch_path
from feedops.sinks import write_csv, write_json, write_lines, write_parquet, write_records
from feedops.sources.csv import read_text_csv

REGISTRY = Registry()
add = REGISTRY.add


@add("w1_write_csv", f"WITH {TEXT_ORDERS} SELECT * FROM text_orders")
def w1(spark, d):
    path = scratch_path(spark, "csv")
    write_csv(text_orders(spark, d), path)
    return read_text_csv(spark, path)


@add("w1_write_csv_gzip", """
SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, source, CAST(n_chars AS VARCHAR) AS n_chars FROM documents""")
def w1_gzip(spark, d):
    path = scratch_path(spark, "csv-gz")
    write_csv(table(spark, d, "documents").drop("text"), path, gzip=True)
    return read_text_csv(spark, path)


@add("w2_write_json", f"WITH {CELLS} SELECT * FROM changed_strict")
def w2(spark, d):
    path = scratch_path(spark, "json")
    cells = cell_changes(*snapshots(spark, d), KEY, nulls="strict")
    write_json(cells, path)
    return spark.read.schema(cells.schema).json(path)


@add("w2_write_json_stats", _stats("changed"))
def w2_stats(spark, d):
    path = scratch_path(spark, "stats")
    stats = diff_stats(*snapshots(spark, d), KEY)
    write_json(stats, path)
    return spark.read.schema(stats.schema).json(path).withColumn("changed_columns", F.array_join("changed_columns", ","))


@add("w3_write_lines", f"WITH {CELLS} SELECT DISTINCT \"column\" AS \"value\" FROM changed")
def w3(spark, d):
    path = scratch_path(spark, "lines")
    write_lines(changed_columns(cell_changes(*snapshots(spark, d), KEY)), path)
    return spark.read.text(path)


@add("w4_write_parquet", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem")
def w4(spark, d):
    path = scratch_path(spark, "parquet")
    write_parquet(table(spark, d, "lineitem"), path, 4)
    return spark.read.parquet(path).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@add("w5_write_records", _long("kept", "coalesce(s.pri, t.pri)"))
def w5(spark, d):
    path = scratch_path(spark, "records")
    write_records(upsert_records(target_records(spark, d), staged_orders(spark, d), "o_custkey", ORDER), path, 1)
    return spark.read.parquet(path).select("id", F.explode("data").alias("attribute", "value"))
