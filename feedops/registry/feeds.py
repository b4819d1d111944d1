"""Reading and staging feeds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedops.functions.values import staged_name
from feedops.operators.diff import cell_changes, change_documents
from feedops.registry.base import Registry, table
from feedops.registry.inputs import (
    CELLS,
    DOCUMENT_FILES,
    ORDER_FEEDS,
    TEXT_ORDERS,
    document_files,
    feed_tree,
    order_feeds,
    raw_files,
    raw_lines,
    snapshots,
    text_orders,
)
from feedops.session import durable, scratch_path
from feedops.sinks import write_change_log, write_csv, write_json
from feedops.sources import csv as src
from feedops.sources.documents import read_change_log, read_meta_json
from feedops.sources.inventory import file_inventory, require_nonempty
from feedops.sources.staging import preview, stage, staged_tables

REGISTRY = Registry()
add = REGISTRY.add


@add("r1_read_text_csv", f"""
WITH {CELLS} SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority, FILEDATE FROM curr""")
def r1(spark, d):
    path = scratch_path(spark, "text")
    write_csv(snapshots(spark, d)[1], path, gzip=True)
    return src.read_text_csv(spark, path)


@add("r1_header_per_file", f"WITH {TEXT_ORDERS} SELECT * FROM text_orders")
def r1_headers(spark, d):
    rows, root = text_orders(spark, d), scratch_path(spark, "swapped")
    done = F.col("o_orderstatus") == "F"
    write_csv(rows.filter(done), f"{root}/a")
    write_csv(rows.filter(~done).select(*reversed(rows.columns)), f"{root}/b")
    return src.read_text_csv(spark, f"{root}/*").select(*rows.columns)


@add("r1_misfit_rows", """
SELECT count(*) AS "rows", count(*) FILTER (WHERE l_linenumber = 7) AS long_rows, 0 AS short_rows FROM lineitem""")
def r1_misfits(spark, d):
    path = scratch_path(spark, "misfits")
    longer = F.when(F.col("l_linenumber") == 7, F.concat(F.lit(","), "l_returnflag")).otherwise("")
    line = F.concat(F.concat_ws(",", "l_orderkey", "l_linenumber", "l_partkey"), longer)
    raw_lines(table(spark, d, "lineitem").select(line), "l_orderkey,l_linenumber,l_partkey", path)
    found = src.misfits(spark, path).agg(F.sum("rows").alias("rows"), F.sum("long_rows").alias("long_rows"), F.sum("short_rows").alias("short_rows"))
    return found


@add("r1_read_text_csv_multiline", """
SELECT CAST(conv_id AS VARCHAR) AS conv_id, CAST(turn AS VARCHAR) AS turn, role, text FROM conversations""")
def r1_multiline(spark, d):
    path = scratch_path(spark, "texts")
    write_csv(table(spark, d, "conversations"), path)
    return src.read_text_csv(spark, path, multi_line=True)


@add("r1_inch_marks", """
SELECT CAST(p_partkey AS VARCHAR) AS id, p_size || '" ' || p_name AS a, p_brand || '"' AS b,
       CASE WHEN p_size % 7 = 0 THEN p_type || ' "x"' END AS column_4
FROM part""")
def r1_inch_marks(spark, d):
    path = scratch_path(spark, "inches")
    more = F.when(F.col("p_size") % 7 == 0, F.concat(F.lit(","), "p_type", F.lit(' "x"'))).otherwise("")
    cells = [F.col("p_partkey").cast("string"), F.concat("p_size", F.lit('" '), "p_name"), F.concat("p_brand", F.lit('"'))]
    raw_lines(table(spark, d, "part").select(F.concat(F.concat_ws(",", *cells), more)), "id,a,b", path)
    return src.read_text_csv(spark, path)


def spanning(spark, d) -> str:
    """``conversations`` with the role and the text on two lines of one quoted cell; every third turn has a cell more."""
    path = scratch_path(spark, "spanning")
    text = F.concat(F.lit('"'), "role", F.lit('\n'), F.replace("text", F.lit('"'), F.lit('""')), F.lit('"'))
    more = F.when(F.col("turn") % 3 == 2, F.concat(F.lit(',5" '), "role")).otherwise("")
    lines = table(spark, d, "conversations").select(
        F.pmod(F.xxhash64("conv_id"), F.lit(8)).alias("part"), F.concat(F.concat_ws(",", "conv_id", "turn", text), more).alias("value")
    )
    raw_files(lines, spark.range(8).select(F.col("id").alias("part"), F.lit("conv_id,turn,text").alias("value")), path)
    return path


@add("r1_wide_rows_beside_line_breaks", """
SELECT CAST(conv_id AS VARCHAR) AS conv_id, CAST(turn AS VARCHAR) AS turn, role || chr(10) || text AS text,
       CASE WHEN turn % 3 = 2 THEN '5" ' || role END AS column_4
FROM conversations""")
def r1_spanning(spark, d):
    return src.read_text_csv(spark, spanning(spark, d), multi_line=True)


@add("r1_misfits_beside_line_breaks", """
SELECT count(*) AS "rows", count(*) FILTER (WHERE turn % 3 = 2) AS long_rows, 0 AS short_rows FROM conversations""")
def r1_spanning_misfits(spark, d):
    found = src.misfits(spark, spanning(spark, d), multi_line=True)
    return found.agg(*[F.sum(c).alias(c) for c in ("rows", "long_rows", "short_rows")])


@add("r1_quarantined_rows", """
SELECT 4 AS cells, 3 AS width, conv_id || ',' || turn || ',"' || role || chr(10) || replace(text, '"', '""') || '",5" ' || role AS line
FROM conversations WHERE turn % 3 = 2""")
def r1_quarantine(spark, d):
    return src.quarantine(spark, spanning(spark, d), multi_line=True).select("cells", "width", "line")


@add("r2_read_inferred_csv", """
SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_returnflag, strftime(l_shipdate, '%Y-%m-%d') AS l_shipdate
FROM lineitem""")
def r2(spark, d):
    path = scratch_path(spark, "typed")
    names = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag"]
    lines = table(spark, d, "lineitem").select(*names, F.to_date("l_shipdate").alias("l_shipdate"))
    write_csv(lines, path)
    back = src.read_inferred_csv(spark, path)
    kinds = dict(back.dtypes)
    numbers = [F.col(n).cast("bigint") if kinds[n] == "int" else F.col(n) for n in names]
    return back.select(*numbers, F.date_format("l_shipdate", "yyyy-MM-dd").alias("l_shipdate"))


@add("r3_read_feed", f"""
WITH {ORDER_FEEDS}
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, substr(o_orderdate, 1, 4) || '1231' AS _source_date,
       'file=' || file AS source_file FROM feeds""")
def r3(spark, d):
    rows = src.read_feed(spark, feed_tree(spark, d))
    return rows.select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "_source_date",
        F.element_at(F.split("_file", "/"), -1).alias("source_file"),
    )


TRANSFERS = "Timestamp,From Bank,Account,To Bank,Account,Amount Paid"


def transfers(spark, d, extra: bool = False) -> str:
    """``lineitem`` as bank transfers: a header with a repeated name; with
    ``extra`` every row has one cell more than the header."""
    lines = table(spark, d, "lineitem")
    cells = [F.date_format("l_shipdate", "yyyy-MM-dd"), "l_suppkey", "l_orderkey", "l_linenumber", "l_partkey",
             F.col("l_extendedprice").cast("decimal(18,2)")]
    path = scratch_path(spark, "transfers")
    raw_lines(lines.select(F.concat_ws(",", *cells, *(["l_returnflag"] if extra else []))), TRANSFERS, path)
    return path


TRANSFER_CELLS = """
SELECT strftime(l_shipdate, '%Y-%m-%d') AS "Timestamp", CAST(l_suppkey AS VARCHAR) AS "From Bank",
       CAST(l_orderkey AS VARCHAR) AS "Account", CAST(l_linenumber AS VARCHAR) AS "To Bank",
       CAST(l_partkey AS VARCHAR) AS "Account_4", CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) AS "Amount Paid\""""


@add("r4_dedupe_header", f"{TRANSFER_CELLS} FROM lineitem")
def r4(spark, d):
    return src.read_text_csv(spark, transfers(spark, d))


@add("r5_column_mapping", """
WITH n AS (SELECT count(*) AS cells FROM lineitem)
SELECT position, original_name, current_name, original_name <> current_name AS renamed, cells
FROM n, (VALUES (0, 'Timestamp', 'Timestamp'), (1, 'From Bank', 'From Bank'), (2, 'Account', 'Account'),
         (3, 'To Bank', 'To Bank'), (4, 'Account', 'Account_4'), (5, 'Amount Paid', 'Amount Paid'))
     AS h(position, original_name, current_name)""")
def r5(spark, d):
    path = transfers(spark, d)
    rows = src.read_text_csv(spark, path)
    counts = rows.agg(*[F.count(F.col(f"`{c}`")).alias(str(i)) for i, c in enumerate(rows.columns)])
    filled = counts.unpivot([], counts.columns, "position", "cells")
    filled = filled.withColumn("position", F.col("position").cast("int"))
    mapping = src.column_mapping(spark, src.head_lines(spark, path, 1)[0].split(","))
    return mapping.join(filled, "position").select("position", "original_name", "current_name", "renamed", "cells")


@add("r6_extend_header", f"{TRANSFER_CELLS}, l_returnflag AS column_7 FROM lineitem")
def r6(spark, d):
    return src.read_text_csv(spark, transfers(spark, d, extra=True))


@add("r7_sniffed_separator", f"WITH {TEXT_ORDERS} SELECT * FROM text_orders")
def r7(spark, d):
    path = scratch_path(spark, "semicolons")
    text_orders(spark, d).write.option("header", True).option("sep", ";").csv(path)
    return src.read_text_csv(spark, path, sep="auto")


@add("r7_sniffed_quote", f"""
WITH {TEXT_ORDERS} SELECT * REPLACE (replace(o_orderpriority, '-', ';') || ' it''s' AS o_orderpriority) FROM text_orders""")
def r7_quote(spark, d):
    path = scratch_path(spark, "apostrophes")
    marked = F.concat(F.replace("o_orderpriority", F.lit("-"), F.lit(";")), F.lit(" it's"))
    rows = text_orders(spark, d).withColumn("o_orderpriority", marked)
    rows.write.option("header", True).option("sep", ";").option("quote", "'").option("escape", "'").csv(path)
    return src.read_text_csv(spark, path, sep="auto", quote="auto")


@add("r9_read_change_log", f"WITH {CELLS} SELECT key, \"column\", previous_value, current_value FROM changed")
def r9(spark, d):
    path = scratch_path(spark, "changes")
    write_change_log(change_documents(cell_changes(*snapshots(spark, d), "o_orderkey")), path)
    return read_change_log(spark, path)


@add("r9_read_meta_json", f"""
WITH {ORDER_FEEDS} SELECT feed AS filename, max(substr(o_orderdate, 1, 4) || '1231') AS "effectiveDate",
       count(*) AS "rowCount", 'o_orderkey' AS column_name, 'integer' AS data_type FROM feeds GROUP BY feed""")
def r9_meta(spark, d):
    path = scratch_path(spark, "meta")
    kind = F.array(F.struct(F.lit("o_orderkey").alias("name"), F.lit("integer").alias("dataType")))
    meta = order_feeds(spark, d).groupBy(F.col("feed").alias("filename")).agg(
        F.max(F.concat(F.substring("o_orderdate", 1, 4), F.lit("1231"))).alias("effectiveDate"),
        F.count("*").alias("rowCount"), F.first(kind).alias("columns"),
    )
    write_json(meta, path)
    back = read_meta_json(spark, path, lines=True).withColumn("c", F.explode("columns"))
    return back.select(
        "filename", "effectiveDate", "rowCount", F.col("c.name").alias("column_name"), F.col("c.dataType").alias("data_type")
    )


@add("r10_staged_name", f"""
WITH {DOCUMENT_FILES}
SELECT name, 'temp_' || regexp_replace(regexp_replace(regexp_replace(name, '[.][^.]*$', ''), '[^a-zA-Z0-9]+', '_', 'g'),
       '^_+|_+$', '', 'g') || '_' || substr(md5(name), 1, 8) AS table_name FROM files""")
def r10(spark, d):
    return document_files(spark, d).select("name", staged_name("name").alias("table_name"))


@add("r11_staged_tables", """
SELECT 'temp_orders_' || lower(o_orderstatus) || '_csv_' || substr(md5('orders_' || o_orderstatus || '.csv.gz'), 1, 8) AS table_name,
       count(*) AS "rows" FROM orders GROUP BY o_orderstatus""")
def r11(spark, d):
    orders = table(spark, d, "orders")
    for status in ("F", "O", "P"):
        stage(orders.filter(F.col("o_orderstatus") == status), f"orders_{status}.csv.gz")
    listed = staged_tables(spark, "temp_orders_")
    counted = [
        spark.table(r["table_name"]).agg(F.count("*").alias("rows")).withColumn("table_name", F.lit(r["table_name"]))
        for r in listed.collect()
    ]
    return reduce(DataFrame.unionByName, counted).select("table_name", "rows")


@add("r11_preview", """SELECT least(100, count(*)) AS "rows", TRUE AS all_known FROM orders""")
def r11_preview(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    rows = durable(preview(spark, stage(orders, "all_orders.csv.gz"), 100))
    known = rows.join(orders, rows.columns, "left_semi").count()
    return rows.agg(F.count("*").alias("rows"), (F.count("*") == known).alias("all_known"))


def _limited(n: int) -> str:
    return f"""
WITH {ORDER_FEEDS}
SELECT o_orderkey, file FROM feeds
QUALIFY row_number() OVER (PARTITION BY file ORDER BY o_orderdate, o_orderkey) <= {n}"""


@add("r12_limit_per_file", _limited(100))
def r12(spark, d):
    rows = src.limit_per_file(order_feeds(spark, d), 100, ["o_orderdate", "o_orderkey"], "file")
    return rows.select("o_orderkey", "file")


@add("r12_limit_per_file_large", _limited(1500))
def r12_large(spark, d):
    rows = src.limit_per_file(order_feeds(spark, d), 1500, ["o_orderdate", "o_orderkey"], "file")
    return rows.select("o_orderkey", "file")


@add("r13_reconcile_counts", f"""
WITH {ORDER_FEEDS},
declared AS (SELECT file AS filename, count(*) AS declared_rows FROM feeds GROUP BY file),
actual AS (SELECT CASE o_orderstatus WHEN 'P' THEN 'elsewhere.csv.gz' ELSE file END AS filename, count(*) AS actual_rows FROM feeds GROUP BY 1),
c AS (SELECT filename, coalesce(declared_rows, 0) AS declared_rows, coalesce(actual_rows, 0) AS actual_rows FROM declared FULL OUTER JOIN actual USING (filename))
SELECT *, CASE WHEN declared_rows > 0 THEN CAST(floor(actual_rows * 100 / declared_rows) AS BIGINT) ELSE -1 END AS percent, declared_rows = actual_rows AS complete FROM c""")
def r13(spark, d):
    """Orders of one status turn up in a file that nobody declared."""
    feeds = order_feeds(spark, d)
    meta = feeds.groupBy(F.col("file").alias("filename")).agg(F.count("*").alias("rowCount"))
    landed = F.when(F.col("o_orderstatus") == "P", F.lit("elsewhere.csv.gz")).otherwise(F.col("file"))
    found = src.reconcile_counts(feeds.withColumn("file", landed), meta, "file")
    return found.withColumn("percent", F.coalesce("percent", F.lit(-1).cast("bigint")))


@add("r14_require_nonempty", f"""
WITH {DOCUMENT_FILES}, s AS (SELECT path, greatest(size - 100, 0) AS size FROM files)
SELECT path, size > 0 AS ok, CASE WHEN size <= 0 THEN 'no bytes in ' || path END AS error FROM s""")
def r14(spark, d):
    inv = document_files(spark, d).withColumn("size", F.greatest(F.col("size") - 100, F.lit(0)))
    return require_nonempty(inv).select("path", "ok", "error")


@add("r14_require_rows", f"""
WITH {ORDER_FEEDS}, f AS (
  SELECT feed AS name, count(*) FILTER (WHERE o_orderstatus <> 'P') AS n FROM feeds GROUP BY feed UNION ALL SELECT 'blank', -1)
SELECT name, greatest(n, 0) AS row_count, n > 0 AS ok, CASE n WHEN -1 THEN 'no header line' WHEN 0 THEN 'no rows' END AS problem FROM f""")
def r14_rows(spark, d):
    """One file per feed, that of status P with its header only, and one of blank lines."""
    path, feeds = scratch_path(spark, "checked"), order_feeds(spark, d)
    lines = feeds.filter(F.col("o_orderstatus") != "P").select(F.col("feed").alias("part"), F.concat_ws(",", "o_orderkey", "o_custkey").alias("value"))
    heads = feeds.select("feed").distinct().select(F.col("feed").alias("part"), F.lit("o_orderkey,o_custkey").alias("value"))
    blank = spark.createDataFrame([("blank", "  ")], "part string, value string")
    raw_files(lines, heads.union(blank), path)
    found = src.require_rows(spark, file_inventory(spark, path, suffixes=()))
    return found.select(
        F.regexp_extract("directory", "part=(.*)", 1).alias("name"), "row_count", "ok", F.regexp_extract("error", "^(.*) in ", 1).alias("problem")
    )
