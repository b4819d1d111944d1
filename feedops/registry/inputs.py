"""Inputs of the checked queries, derived from whole tables, as Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedops.registry.base import table
from feedops.session import scratch_path
from feedops.sinks import write_csv

NO_PRIORITY = "4-NOT SPECIFIED"


def money(c: str) -> Column:
    return F.col(c).cast("decimal(18,2)")


def text_orders(spark: SparkSession, d: str, when: str | None = None) -> DataFrame:
    """``orders`` with every column as text, as a feed would hold it.

    ``when`` is a condition on the table, which reaches its scan.
    """
    orders = table(spark, d, "orders")
    return (orders.filter(when) if when else orders).select(
        F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), "o_orderstatus",
        money("o_totalprice").cast("string").alias("o_totalprice"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"), "o_orderpriority",
    )


TEXT_ORDERS = """text_orders AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus,
         CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS o_totalprice,
         strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority
  FROM orders)"""


def snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Two snapshots of ``orders``: the earlier one ends with 2000, the later one
    has archived 1995, completed the open orders, put a surcharge on urgent ones
    and lost the unspecified priorities."""
    prev = text_orders(spark, d, "o_orderdate < '2001-01-01'").withColumn("FILEDATE", F.lit("20010101"))
    urgent = F.col("o_orderpriority") == "1-URGENT"
    price = F.col("o_totalprice").cast("decimal(18,2)")
    curr = text_orders(spark, d, "o_orderdate >= '1996-01-01'").select(
        "o_orderkey", "o_custkey",
        F.when(F.col("o_orderstatus") == "O", "F").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"),
        F.when(urgent, (price + F.lit(1).cast("decimal(3,2)")).cast("decimal(18,2)")).otherwise(price)
        .cast("string").alias("o_totalprice"),
        "o_orderdate",
        F.when(F.col("o_orderpriority") != NO_PRIORITY, F.col("o_orderpriority")).alias("o_orderpriority"),
        F.lit("20010801").alias("FILEDATE"),
    )
    return prev, curr


SNAPSHOTS = f"""{TEXT_ORDERS},
prev AS (SELECT *, '20010101' AS FILEDATE FROM text_orders WHERE o_orderdate < '2001-01-01'),
curr AS (
  SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'O' THEN 'F' ELSE o_orderstatus END AS o_orderstatus,
         CASE WHEN o_orderpriority = '1-URGENT'
              THEN CAST(CAST(CAST(o_totalprice AS DECIMAL(18,2)) + 1.00 AS DECIMAL(18,2)) AS VARCHAR)
              ELSE o_totalprice END AS o_totalprice,
         o_orderdate, CASE WHEN o_orderpriority <> '{NO_PRIORITY}' THEN o_orderpriority END AS o_orderpriority,
         '20010801' AS FILEDATE
  FROM text_orders WHERE o_orderdate >= '1996-01-01')"""

# one row per cell of both snapshots, aligned by key
CELLS = f"""{SNAPSHOTS},
pairs AS (SELECT p.o_orderkey AS key, p.o_custkey AS p1, c.o_custkey AS c1, p.o_orderstatus AS p2,
                c.o_orderstatus AS c2, p.o_totalprice AS p3, c.o_totalprice AS c3, p.o_orderdate AS p4,
                c.o_orderdate AS c4, p.o_orderpriority AS p5, c.o_orderpriority AS c5
         FROM prev p JOIN curr c ON p.o_orderkey = c.o_orderkey),
cells AS (
  SELECT key, 'o_custkey' AS "column", p1 AS previous_value, c1 AS current_value FROM pairs
  UNION ALL SELECT key, 'o_orderstatus', p2, c2 FROM pairs
  UNION ALL SELECT key, 'o_totalprice', p3, c3 FROM pairs
  UNION ALL SELECT key, 'o_orderdate', p4, c4 FROM pairs
  UNION ALL SELECT key, 'o_orderpriority', p5, c5 FROM pairs),
changed AS (SELECT * FROM cells WHERE previous_value <> current_value),
changed_strict AS (SELECT * FROM cells WHERE previous_value IS DISTINCT FROM current_value)"""


def order_feeds(spark: SparkSession, d: str) -> DataFrame:
    """``orders`` as dated feeds: one file per status and year, keyed by customer."""
    orders = text_orders(spark, d)
    year = F.substring("o_orderdate", 1, 4)
    return orders.withColumn("feed", F.concat(F.lit("orders_"), F.col("o_orderstatus"))).withColumn(
        "file", F.concat(F.lit("orders."), year, F.lit("1231.csv.gz"))
    )


ORDER_FEEDS = f"""{TEXT_ORDERS},
feeds AS (SELECT *, 'orders_' || o_orderstatus AS feed, 'orders.' || substr(o_orderdate, 1, 4) || '1231.csv.gz' AS file
          FROM text_orders)"""


def feed_tree(spark: SparkSession, d: str) -> str:
    """``order_feeds`` written as gz CSV files; returns the root folder."""
    root = scratch_path(spark, "feeds")
    rows = order_feeds(spark, d)
    write_csv(rows.hint("rebalance", "feed", "file"), root, gzip=True, partition_by=["feed", "file"])
    return root


def document_files(spark: SparkSession, d: str) -> DataFrame:
    """An inventory with one file per document. Names carry a date, but for
    Spanish texts, whose names carry none, and texts over 9 999 characters, whose
    digits are no calendar day."""
    docs = table(spark, d, "documents")
    day = F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), F.col("n_chars").cast("int")), "yyyyMMdd")
    stamp = (
        F.when(F.col("lang") == "es", F.lit("undated")).when(F.col("n_chars") > 9999, F.lit("20249999")).otherwise(day)
    )
    directory = F.concat_ws("/", F.lit("vendor"), F.upper("lang"), F.concat(F.col("source"), F.lit("_equity")))
    return docs.select(
        directory.alias("directory"),
        F.concat(F.lit("feed"), F.col("doc_id").cast("string"), F.lit(".out."), stamp, F.lit(".csv.gz")).alias("name"),
        F.col("n_chars").cast("bigint").alias("size"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(secs=(F.col("n_chars") * 7).cast("decimal(18,6)")))
        .alias("mtime"),
    ).withColumn("path", F.concat_ws("/", "directory", "name"))


DOCUMENT_FILES = """files0 AS (
  SELECT 'vendor/' || upper(lang) || '/' || source || '_equity' AS directory,
         'feed' || CAST(doc_id AS VARCHAR) || '.out.' ||
         CASE WHEN lang = 'es' THEN 'undated' WHEN n_chars > 9999 THEN '20249999'
              ELSE strftime(DATE '2020-01-01' + CAST(n_chars AS INTEGER), '%Y%m%d') END || '.csv.gz' AS name,
         CAST(n_chars AS BIGINT) AS size,
         TIMESTAMP '2024-01-01 00:00:00' + to_seconds(CAST(n_chars * 7 AS BIGINT)) AS mtime
  FROM documents),
files AS (SELECT *, directory || '/' || name AS path, nullif(regexp_extract(name, '([0-9]{8})', 1), '') AS date_text,
                 CAST(try_strptime(nullif(regexp_extract(name, '([0-9]{8})', 1), ''), '%Y%m%d') AS DATE) AS effective_date
          FROM files0)"""


def raw_cells(spark: SparkSession, d: str) -> DataFrame:
    """``part`` with a text column ``raw`` of mixed content: null tokens, numbers,
    booleans, dates and free text."""
    part = table(spark, d, "part")
    size, key = F.col("p_size"), F.col("p_partkey").cast("string")
    raw = (
        F.when(size <= 3, F.lit("N.A.")).when(size <= 6, F.lit("")).when(size <= 9, F.lit(" none "))
        .when(size <= 14, key).when(size <= 18, F.concat(F.lit("00"), key)).when(size <= 22, F.concat(key, F.lit(".5")))
        .when(size <= 25, F.concat(F.lit("-"), key)).when(size <= 28, F.lit("TRUE")).when(size <= 31, F.lit("2024-01-31"))
        .when(size <= 33, F.lit("2024-13-01")).when(size <= 36, F.lit("2024-01-31 10:00:00"))
        .when(size <= 39, F.concat(key, F.lit("e2"))).when(size <= 41, F.concat(F.lit(" "), key))
        .when(size <= 43, F.concat(key, F.lit("/7"))).otherwise(F.col("p_name"))
    )
    return part.select(F.col("p_partkey"), "p_size", "p_brand", raw.alias("raw"))


RAW_CELLS = """cells AS (
  SELECT p_partkey, p_size, p_brand,
         CASE WHEN p_size <= 3 THEN 'N.A.' WHEN p_size <= 6 THEN '' WHEN p_size <= 9 THEN ' none '
              WHEN p_size <= 14 THEN CAST(p_partkey AS VARCHAR) WHEN p_size <= 18 THEN '00' || CAST(p_partkey AS VARCHAR)
              WHEN p_size <= 22 THEN CAST(p_partkey AS VARCHAR) || '.5' WHEN p_size <= 25 THEN '-' || CAST(p_partkey AS VARCHAR)
              WHEN p_size <= 28 THEN 'TRUE' WHEN p_size <= 31 THEN '2024-01-31' WHEN p_size <= 33 THEN '2024-13-01'
              WHEN p_size <= 36 THEN '2024-01-31 10:00:00' WHEN p_size <= 39 THEN CAST(p_partkey AS VARCHAR) || 'e2'
              WHEN p_size <= 41 THEN ' ' || CAST(p_partkey AS VARCHAR) WHEN p_size <= 43 THEN CAST(p_partkey AS VARCHAR) || '/7'
              ELSE p_name END AS raw
  FROM part)"""


def raw_lines(df: DataFrame, header: str, path: str) -> None:
    """Writes ready-made lines (one column) under a header line of any shape."""
    named = df.toDF(header)
    named.write.option("header", True).option("sep", "\x01").option("quote", "\x00").option("escape", "\x00").csv(path)


def raw_files(lines: DataFrame, heads: DataFrame, path: str) -> None:
    """Writes ready-made lines (``part, value``), which may hold line breaks, as one text file per part below its head."""
    both = heads.select("part", F.lit(0).alias("order"), "value").union(lines.select("part", F.lit(1), "value"))
    both.repartition("part").sortWithinPartitions("part", "order").select("part", "value").write.partitionBy("part").text(path)
