"""Merge and upsert."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedops.functions.values import type_value
from feedops.operators import merge as op
from feedops.registry.base import Registry, table
from feedops.registry.inputs import (
    NO_PRIORITY,
    ORDER_FEEDS,
    RAW_CELLS,
    TEXT_ORDERS,
    feed_tree,
    order_feeds,
    raw_cells,
    text_orders,
)
from feedops.sources.csv import read_feed

REGISTRY = Registry()
add = REGISTRY.add
ORDER = ["o_orderdate", "o_orderkey"]

PERIODS = f"""{TEXT_ORDERS},
newest AS (SELECT * FROM text_orders WHERE o_orderdate >= '2000-01-01'
           QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1),
middle AS (SELECT * FROM text_orders WHERE o_orderdate >= '1998-01-01' AND o_orderdate < '2000-01-01'
           QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1),
oldest AS (SELECT * FROM text_orders WHERE o_orderdate < '1998-01-01'
           QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)"""


def periods(spark, d):
    """Three dated frames with overlapping columns, many rows per customer."""
    newest = text_orders(spark, d, "o_orderdate >= '2000-01-01'")
    newest = newest.select("o_custkey", "o_orderstatus", "o_orderkey", "o_orderdate")
    middle = text_orders(spark, d, "o_orderdate >= '1998-01-01' AND o_orderdate < '2000-01-01'").drop("o_orderpriority")
    oldest = text_orders(spark, d, "o_orderdate < '1998-01-01'")
    oldest = oldest.select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    return [("19971231", oldest), ("20010801", newest), ("19991231", middle)]


@add("m1_merge_newest_columns", f"""
WITH {PERIODS}
SELECT coalesce(n.o_custkey, m.o_custkey) AS o_custkey, n.o_orderstatus, n.o_orderkey, n.o_orderdate, m.o_totalprice
FROM newest n FULL OUTER JOIN middle m ON n.o_custkey = m.o_custkey""")
def m1(spark, d):
    frames = periods(spark, d)
    return op.merge_newest_columns(frames, "o_custkey", {date: ORDER for date, _ in frames})


@add("m1_merge_keep_all_keys", f"""
WITH {PERIODS}, keys AS (SELECT DISTINCT o_custkey FROM text_orders)
SELECT k.o_custkey, n.o_orderstatus, n.o_orderkey, n.o_orderdate, m.o_totalprice
FROM keys k LEFT JOIN newest n ON n.o_custkey = k.o_custkey LEFT JOIN middle m ON m.o_custkey = k.o_custkey""")
def m1_all(spark, d):
    frames = periods(spark, d)
    return op.merge_newest_columns(frames, "o_custkey", {date: ORDER for date, _ in frames}, keep_all_keys=True)


def target_records(spark, d):
    """A record per customer; those not in credit are known by another key, so their orders find none."""
    customers = table(spark, d, "customer")
    own = F.col("c_custkey").cast("string")
    data = F.create_map(
        F.lit("c_name"), F.col("c_name"), F.lit("c_mktsegment"), F.col("c_mktsegment"),
        F.lit("o_orderpriority"), F.lit("0-NONE"),
    )
    return customers.select(F.when(F.col("c_acctbal") >= 0, own).otherwise(F.concat(F.lit("C"), own)).alias("id"), data.alias("data"))


def staged_orders(spark, d):
    """Orders as staged text: null tokens and a missing priority in places."""
    return text_orders(spark, d).select(
        F.col("o_custkey").alias("O_CUSTKEY"), "o_orderkey", "o_orderdate",
        F.when(F.col("o_orderpriority") != NO_PRIORITY, F.col("o_orderpriority")).alias("o_orderpriority"),
        F.when(F.col("o_totalprice").cast("double") > 400000, "N.A.").otherwise(F.col("o_totalprice")).alias("Order"),
        F.lit("20010801").alias("FILEDATE"),
    )


RECORDS = f"""{TEXT_ORDERS},
tgt AS (SELECT CASE WHEN c_acctbal >= 0 THEN '' ELSE 'C' END || c_custkey AS id, c_name, c_mktsegment, '0-NONE' AS pri FROM customer),
staged AS (SELECT o_custkey AS id, o_orderkey, o_orderdate, o_orderdate || ' ' || o_orderkey AS ord,
                  CASE WHEN o_orderpriority <> '{NO_PRIORITY}' THEN o_orderpriority END AS pri,
                  CASE WHEN CAST(o_totalprice AS DOUBLE) > 400000 THEN NULL ELSE o_totalprice END AS price
           FROM text_orders),
kept AS (SELECT id, arg_max(o_orderkey, ord) AS okey, arg_max(o_orderdate, ord) AS odate,
                arg_max(pri, ord) FILTER (WHERE pri IS NOT NULL) AS pri,
                arg_max(price, ord) FILTER (WHERE price IS NOT NULL) AS price FROM staged GROUP BY id),
latest AS (SELECT id, o_orderkey AS okey, o_orderdate AS odate, pri, price FROM staged
           QUALIFY row_number() OVER (PARTITION BY id ORDER BY ord DESC) = 1)"""


def _long(new: str, priority: str, join: str = "FULL OUTER", price: str = "Order", okey: str = "o_orderkey",
          odate: str = "o_orderdate", pri: str = "o_orderpriority", strip: bool = False) -> str:
    inserted = "" if join == "FULL OUTER" else "WHERE s.id IN (SELECT id FROM tgt)"
    rows = f"""
SELECT id, 'c_name' AS attribute, c_name AS "value" FROM tgt
UNION ALL SELECT id, 'c_mktsegment', c_mktsegment FROM tgt
UNION ALL SELECT id, '{okey}', okey FROM {new} s {inserted}
UNION ALL SELECT id, '{odate}', odate FROM {new} s {inserted}
UNION ALL SELECT id, '{price}', price FROM {new} s {inserted}
UNION ALL SELECT coalesce(t.id, s.id), '{pri}', {priority} FROM tgt t {join} JOIN {new} s ON t.id = s.id"""
    body = f"SELECT * FROM ({rows})" + (' WHERE "value" IS NOT NULL' if strip else "")
    return f"WITH {RECORDS} {body}"


def _exploded(records):
    return records.select("id", F.explode("data").alias("attribute", "value"))


@add("m2_upsert_records", _long("kept", "coalesce(s.pri, t.pri)"))
def m2(spark, d):
    return _exploded(op.upsert_records(target_records(spark, d), staged_orders(spark, d), "o_custkey", ORDER))


@add("m3_upsert_overwrite", _long("latest", "CASE WHEN s.id IS NOT NULL THEN s.pri ELSE t.pri END"))
def m3(spark, d):
    return _exploded(op.upsert_records(
        target_records(spark, d), staged_orders(spark, d), "o_custkey", ORDER, null_policy="overwrite"
    ))


@add("m4_update_only", _long("kept", "coalesce(s.pri, t.pri)", join="LEFT"))
def m4(spark, d):
    return _exploded(op.upsert_records(
        target_records(spark, d), staged_orders(spark, d), "o_custkey", ORDER, insert_missing=False
    ))


@add("m5_lower_names_strip_nulls", _long("kept", "coalesce(s.pri, t.pri)", price="order", strip=True))
def m5(spark, d):
    return _exploded(op.upsert_records(
        target_records(spark, d), staged_orders(spark, d), "o_custkey", ORDER, strip_nulls=True, key_case="lower"
    ))


@add("m6_exclude_and_key", f"""
WITH {RECORDS}
SELECT id, 'o_orderkey' AS attribute, okey AS "value" FROM kept
UNION ALL SELECT id, 'o_orderpriority', pri FROM kept UNION ALL SELECT id, 'Order', price FROM kept""")
def m6(spark, d):
    return _exploded(op.to_records(staged_orders(spark, d), "o_custkey", ORDER, exclude=["filedate", "O_ORDERDATE"]))


@add("m7_reserved_names", f"""
WITH {RECORDS}
SELECT id, 'o_orderkey' AS attribute, okey AS "value" FROM kept UNION ALL SELECT id, 'o_orderdate', odate FROM kept
UNION ALL SELECT id, 'o_orderpriority', pri FROM kept UNION ALL SELECT id, '_order', price FROM kept""")
def m7(spark, d):
    return _exploded(op.to_records(
        staged_orders(spark, d), "o_custkey", ORDER, key_case="lower", reserved="prefix"
    ))


@add("m8_type_value", f"""
WITH {RAW_CELLS},
t AS (SELECT p_partkey, raw, CASE WHEN raw IS NULL OR raw = '' OR upper(raw) = 'N.A.' THEN 'null'
        WHEN regexp_full_match(raw, '[0-9]+([.][0-9]+)?') THEN 'number' WHEN lower(raw) IN ('true', 'false') THEN 'boolean'
        WHEN regexp_matches(raw, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}[T ]?[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}')
             AND try_cast(substr(raw, 1, 10) AS DATE) IS NOT NULL THEN 'timestamp'
        WHEN regexp_full_match(raw, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AND try_cast(raw AS DATE) IS NOT NULL THEN 'date'
        ELSE 'text' END AS value_type FROM cells)
SELECT p_partkey, CASE value_type WHEN 'null' THEN NULL WHEN 'boolean' THEN lower(raw) ELSE raw END AS "value", value_type
FROM t""")
def m8(spark, d):
    return raw_cells(spark, d).select("p_partkey", type_value("raw").alias("v")).select("p_partkey", "v.*")


@add("m9_valid_keys", f"""
WITH {RAW_CELLS} SELECT p_partkey, raw FROM cells WHERE raw IS NOT NULL AND raw <> ''""")
def m9(spark, d):
    return op.valid_keys(raw_cells(spark, d), "raw").select("p_partkey", "raw")


@add("m10_load_report", """
SELECT count(*) AS total_files, count(*) FILTER (WHERE event_type <> 'error') AS successful_files,
       count(*) FILTER (WHERE event_type = 'error') AS failed_files,
       CAST(sum(CAST(props->>'k' AS BIGINT)) FILTER (WHERE event_type <> 'error') AS BIGINT) AS total_rows,
       round(sum("value"), 2) AS total_seconds, round(avg("value"), 4) AS seconds_per_file,
       round(sum(CAST(props->>'k' AS BIGINT)) FILTER (WHERE event_type <> 'error') / sum("value"), 4) AS rows_per_second
FROM events""")
def m10(spark, d):
    events = table(spark, d, "events")
    runs = events.select(
        F.concat(F.lit("file"), F.col("event_id").cast("string")).alias("file_path"),
        F.when(F.col("event_type") == "error", "error").otherwise("success").alias("status"),
        F.get_json_object("props", "$.k").cast("bigint").alias("rows_processed"),
        F.col("value").alias("processing_time_seconds"),
    )
    report = op.load_report(runs)
    return report.select(
        "total_files", "successful_files", "failed_files", "total_rows", F.round("total_seconds", 2).alias("total_seconds"),
        F.round("seconds_per_file", 4).alias("seconds_per_file"), F.round("rows_per_second", 4).alias("rows_per_second"),
    )


@add("m10_load_runs", f"""
WITH {ORDER_FEEDS}
SELECT file AS file_path, 'error' AS status, count(*) FILTER (WHERE o_orderpriority <> '{NO_PRIORITY}') AS rows_processed,
       CAST(count(*) FILTER (WHERE o_orderpriority = '{NO_PRIORITY}') AS VARCHAR) || ' malformed rows' AS error_message
FROM feeds GROUP BY file""")
def m10_runs(spark, d):
    runs = op.load_runs(order_feeds(spark, d), "file", F.col("o_orderpriority") == NO_PRIORITY)
    return runs.drop("processing_time_seconds")


@add("m10_measured_runs", f"""
WITH {ORDER_FEEDS}
SELECT 'file=' || file AS name, 'success' AS status, count(*) AS rows_processed, TRUE AS timed FROM feeds GROUP BY feed, file""")
def m10_measured(spark, d):
    """Every file of the feeds read, with the time that took."""
    runs = op.load_runs(read_feed(spark, feed_tree(spark, d), clock=True))
    name = F.element_at(F.split("file_path", "/"), -1).alias("name")
    return runs.select(name, "status", "rows_processed", (F.col("processing_time_seconds") > 0).alias("timed"))


@add("m10_load_report_of_runs", f"""
WITH {ORDER_FEEDS},
runs AS (SELECT file, count(*) AS "all", count(*) FILTER (WHERE o_orderpriority = '{NO_PRIORITY}' AND CAST(o_orderkey AS BIGINT) % 1000 = 1) AS bad FROM feeds GROUP BY file)
SELECT count(*) + 1 AS total_files, count(*) FILTER (WHERE bad = 0) AS successful_files, count(*) FILTER (WHERE bad > 0) + 1 AS failed_files,
       CAST(coalesce(sum("all") FILTER (WHERE bad = 0), 0) AS BIGINT) AS total_rows FROM runs""")
def m10_chain(spark, d):
    rows = order_feeds(spark, d)
    files = rows.select(F.col("file").alias("path")).distinct().union(spark.createDataFrame([("without-rows.csv",)], "path string"))
    bad = (F.col("o_orderpriority") == NO_PRIORITY) & (F.col("o_orderkey").cast("long") % 1000 == 1)
    report = op.load_report(op.load_runs(rows, "file", bad, files))
    return report.select("total_files", "successful_files", "failed_files", "total_rows")


@add("m11_verify_records", f"""
WITH {RECORDS},
a AS (SELECT coalesce(t.id, s.id) AS id, CASE WHEN t.id IS NULL THEN 0 ELSE 2 END + 1 + CASE WHEN s.id IS NULL THEN 0 ELSE 3 END AS n
      FROM tgt t FULL OUTER JOIN kept s ON t.id = s.id)
SELECT count(*) AS total_records, count(*) AS with_data, 0 AS empty_records, CAST(sum(n) AS BIGINT) AS total_attributes,
       CAST(min(n) AS BIGINT) AS min_attributes, CAST(max(n) AS BIGINT) AS max_attributes FROM a""")
def m11(spark, d):
    return op.verify_records(
        op.upsert_records(target_records(spark, d), staged_orders(spark, d), "o_custkey", ORDER)
    )


@add("m11_attribute_counts", f"""
WITH {RECORDS}
SELECT coalesce(t.id, s.id) AS id, CASE WHEN t.id IS NULL THEN 0 ELSE 2 END + 1 + CASE WHEN s.id IS NULL THEN 0 ELSE 3 END AS attributes
FROM tgt t FULL OUTER JOIN kept s ON t.id = s.id""")
def m11_counts(spark, d):
    return op.attribute_counts(
        op.upsert_records(target_records(spark, d), staged_orders(spark, d), "o_custkey", ORDER)
    )


@add("m12_track_keys", f"""
WITH {ORDER_FEEDS},
k AS (SELECT o_custkey, file, count(*) AS n FROM feeds GROUP BY o_custkey, file)
SELECT o_custkey AS "KEY", CAST(sum(n) AS BIGINT) AS "COUNT", string_agg(file, ',' ORDER BY file) AS "EXISTS_IN"
FROM k GROUP BY o_custkey""")
def m12(spark, d):
    return op.track_keys(order_feeds(spark, d), "o_custkey", "file")


@add("m12_track_keys_by_file", """
SELECT CAST(l_partkey AS VARCHAR) AS key, strftime(l_shipdate, '%Y') AS file, count(*) AS "count" FROM lineitem GROUP BY 1, 2""")
def m12_by_file(spark, d):
    lines = table(spark, d, "lineitem").withColumn("year", F.date_format("l_shipdate", "yyyy"))
    return op.track_keys_by_file(lines, "l_partkey", "year")


@add("m13_upsert_preview", f"""
WITH {RECORDS}
SELECT count(*) FILTER (WHERE t.id IS NULL) AS inserted, count(*) FILTER (WHERE t.id IS NOT NULL) AS updated,
       0 AS unchanged FROM kept s LEFT JOIN tgt t ON t.id = s.id""")
def m13(spark, d):
    return op.upsert_preview(target_records(spark, d), staged_orders(spark, d), "o_custkey", ORDER)


@add("m13_upsert_preview_again", f"""
WITH {RECORDS} SELECT 0 AS inserted, 0 AS updated, count(*) AS unchanged FROM kept""")
def m13_again(spark, d):
    staged = staged_orders(spark, d)
    after = op.upsert_records(target_records(spark, d), staged, "o_custkey", ORDER)
    return op.upsert_preview(after, staged, "o_custkey", ORDER)
