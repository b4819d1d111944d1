"""File discovery."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedops.operators import discovery as op
from feedops.registry.base import Registry, table
from feedops.registry.inputs import DOCUMENT_FILES, ORDER_FEEDS, document_files, feed_tree, text_orders
from feedops.session import scratch_path
from feedops.sources.inventory import expand_paths, file_inventory, logical_inventory
from feedops.sources.listing import list_files, match_files
from feedops.streaming.ingest import ingest_incremental

REGISTRY = Registry()
add = REGISTRY.add


@add("f1_file_inventory", f"""
WITH {ORDER_FEEDS}
SELECT DISTINCT 'feed=' || feed AS directory, 'file=' || file AS name, TRUE AS has_bytes FROM feeds""")
def f1(spark, d):
    root = feed_tree(spark, d)
    inv = logical_inventory(file_inventory(spark, root, [".csv.gz"]), root)
    return inv.select("directory", "name", (F.col("size") > 0).alias("has_bytes"))


@add("f1_list_files", f"""
WITH {ORDER_FEEDS}
SELECT DISTINCT 'feed=' || feed AS directory, 'file=' || file AS name, TRUE AS has_bytes FROM feeds""")
def f1_tasks(spark, d):
    root = feed_tree(spark, d)
    inv = logical_inventory(list_files(spark, root, [".csv.gz"]), root)
    return inv.select("directory", "name", (F.col("size") > 0).alias("has_bytes"))


@add("f2_filter_dirs_levels", f"""
WITH {DOCUMENT_FILES},
p AS (SELECT *, string_split(directory, '/') AS parts FROM files)
SELECT directory, name FROM p
WHERE len(list_filter([parts[1] || '/', parts[1] || '/' || parts[2] || '/', directory || '/'],
      lambda l: NOT (regexp_matches(l, 'vendor/(EN/$|EN/src[0-9]+_|$|DE)') AND NOT regexp_matches(l, 'src1_')))) = 0""")
def f2(spark, d):
    inv = document_files(spark, d)
    return op.filter_dirs(inv, "vendor/(EN/$|EN/src[0-9]+_|$|DE)", "src1_").select("directory", "name")


@add("f2_filter_dirs_leaf", f"""
WITH {DOCUMENT_FILES}
SELECT name FROM files WHERE regexp_matches(split_part(directory, '/', 2), '^(EN|DE)$')
  AND NOT regexp_matches(split_part(directory, '/', 2), 'DE')""")
def f2_leaf(spark, d):
    inv = document_files(spark, d).withColumn("directory", F.regexp_replace("directory", "^vendor/", ""))
    return op.filter_dirs(inv, "^(EN|DE)$", "DE", mode="leaf").select("name")


@add("f3_folders_containing", f"""
WITH {DOCUMENT_FILES} SELECT DISTINCT directory FROM files WHERE contains(upper(directory), 'EQUITY')""")
def f3(spark, d):
    return op.folders_containing(document_files(spark, d), "Equity")


@add("f4_effective_date", f"""
WITH {DOCUMENT_FILES}
SELECT name, date_text, strftime(effective_date, '%Y-%m-%d') AS effective_date,
       CASE WHEN date_text IS NULL THEN 'name without a yyyymmdd date: ' || name
            WHEN effective_date IS NULL THEN 'name with an impossible date: ' || name END AS error
FROM files""")
def f4(spark, d):
    dated = op.with_effective_date(document_files(spark, d))
    return dated.select("name", "date_text", F.date_format("effective_date", "yyyy-MM-dd").alias("effective_date"), "error")


@add("f5_latest_per_dir", f"""
WITH {DOCUMENT_FILES}
SELECT directory, name, strftime(effective_date, '%Y-%m-%d') AS effective_date FROM files
WHERE effective_date IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY directory ORDER BY effective_date DESC, name DESC) = 1""")
def f5(spark, d):
    out = op.latest_per_dir(document_files(spark, d))
    return out.select("directory", "name", F.date_format("effective_date", "yyyy-MM-dd").alias("effective_date"))


@add("f6_recent_per_dir", f"""
WITH {DOCUMENT_FILES}
SELECT directory, name, size, CAST(row_number() OVER (PARTITION BY directory ORDER BY mtime DESC, name DESC) AS INTEGER) AS rank
FROM files QUALIFY rank <= 2""")
def f6(spark, d):
    return op.recent_per_dir(document_files(spark, d), 2).select("directory", "name", "size", "rank")


@add("f6_total_size", f"""
WITH {DOCUMENT_FILES},
picked AS (SELECT size FROM files QUALIFY row_number() OVER (PARTITION BY directory ORDER BY mtime DESC, name DESC) <= 2)
SELECT count(*) AS files, CAST(sum(size) AS BIGINT) AS total_size FROM picked""")
def f6_total(spark, d):
    return op.total_size(op.recent_per_dir(document_files(spark, d), 2))


@add("f7_snapshot_pair", f"""
WITH {DOCUMENT_FILES},
ranked AS (SELECT *, row_number() OVER (PARTITION BY directory
             ORDER BY coalesce(CAST(effective_date AS TIMESTAMP), mtime) DESC, mtime DESC, name DESC) AS rank FROM files)
SELECT directory, max(CASE WHEN rank = 1 THEN path END) AS "current", max(CASE WHEN rank = 2 THEN path END) AS previous,
       CASE WHEN max(rank) < 2 THEN 'a pair needs two files' END AS error
FROM ranked WHERE rank <= 2 GROUP BY directory""")
def f7(spark, d):
    return op.snapshot_pair(document_files(spark, d))


@add("f7_snapshot_pair_mtime", f"""
WITH {DOCUMENT_FILES},
ranked AS (SELECT *, row_number() OVER (PARTITION BY directory ORDER BY mtime DESC, name DESC) AS rank FROM files)
SELECT directory, max(CASE WHEN rank = 1 THEN path END) AS "current", max(CASE WHEN rank = 2 THEN path END) AS previous
FROM ranked WHERE rank <= 2 GROUP BY directory""")
def f7_mtime(spark, d):
    return op.snapshot_pair(document_files(spark, d), by="mtime").drop("error")


@add("f8_expand_paths", f"""
WITH {ORDER_FEEDS} SELECT DISTINCT 'feed=' || feed AS directory, 'file=' || file AS name FROM feeds
WHERE feed IN ('orders_F', 'orders_P')""")
def f8(spark, d):
    root = feed_tree(spark, d)
    found = expand_paths(spark, [f"{root}/feed=orders_F/*/*.gz", f"{root}/feed=orders_[FP]/*/*.gz"])
    part = F.split("path", "/")
    return found.select(F.element_at(part, -3).alias("directory"), F.element_at(part, -2).alias("name")).distinct()


@add("f8_match_files", f"""
WITH {ORDER_FEEDS} SELECT DISTINCT 'feed=' || feed AS directory, 'file=' || file AS name FROM feeds
WHERE feed IN ('orders_F', 'orders_P') AND file LIKE '%199%'""")
def f8_tasks(spark, d):
    root = feed_tree(spark, d)
    found = match_files(spark, [f"{root}/feed=orders_{{F,P}}/*199*/*.gz", f"{root}/feed=orders_[^O]/*.199?1231*/*.gz"])
    part = F.split("path", "/")
    return found.select(F.element_at(part, -3).alias("directory"), F.element_at(part, -2).alias("name")).distinct()


@add("f9_top_files_by_rows", """
SELECT 'u' || CAST(user_id AS VARCHAR) AS filename, count(*) AS "rowCount" FROM events
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def f9(spark, d):
    events = table(spark, d, "events")
    meta = events.groupBy(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("filename")).agg(
        F.count("*").alias("rowCount")
    )
    return op.top_files_by_rows(meta, 10)


@add("f10_ingest_incremental", """
SELECT strftime(o_orderdate, '%Y') AS year, count(*) AS "rows", 0 AS rows_second_run, count(*) AS rows_after
FROM orders GROUP BY 1""")
def f10(spark, d):
    orders = text_orders(spark, d)
    root = scratch_path(spark, "ingest")
    orders.withColumn("year", F.substring("o_orderdate", 1, 4)).write.parquet(f"{root}/src")
    schema = spark.read.parquet(f"{root}/src").schema
    run = lambda: ingest_incremental(spark, f"{root}/src", schema, f"{root}/sink", f"{root}/state")
    run()
    first = spark.read.parquet(f"{root}/sink").groupBy("year").agg(F.count("*").alias("rows"))
    first.write.parquet(f"{root}/first")
    again = run()
    after = spark.read.parquet(f"{root}/sink").groupBy("year").agg(F.count("*").alias("rows_after"))
    return spark.read.parquet(f"{root}/first").join(after, "year").select(
        "year", "rows", F.lit(again).alias("rows_second_run"), "rows_after"
    )


@add("f10_ingest_batches", """
SELECT strftime(o_orderdate, '%Y') AS year, count(*) AS "rows",
       (SELECT count(*) FROM orders WHERE o_orderpriority = '1-URGENT') AS rows_second_run
FROM orders GROUP BY 1""")
def f10_batches(spark, d):
    """Files one by one, and files that come after the first run: the urgent orders."""
    orders = text_orders(spark, d).withColumn("year", F.substring("o_orderdate", 1, 4))
    root, urgent = scratch_path(spark, "ingest"), F.col("o_orderpriority") == "1-URGENT"
    schema = orders.schema
    run = lambda: ingest_incremental(
        spark, f"{root}/src", schema, f"{root}/sink", f"{root}/state", options={"maxFilesPerTrigger": "1"}
    )
    orders.filter(~urgent).repartition(3).write.parquet(f"{root}/src")
    run()
    orders.filter(urgent).repartition(2).write.mode("append").parquet(f"{root}/src")
    late = run()
    loaded = spark.read.parquet(f"{root}/sink").groupBy("year").agg(F.count("*").alias("rows"))
    return loaded.withColumn("rows_second_run", F.lit(late))
