"""Ad-hoc queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedops.operators import query as op
from feedops.registry.base import Registry, table
from feedops.registry.feeds import TRANSFER_CELLS, transfers
from feedops.session import durable
from feedops.sources.csv import dedupe_header, head_lines, read_text_csv

REGISTRY = Registry()
add = REGISTRY.add


@add("q1_select_cols", "SELECT p_partkey, p_name, p_retailprice FROM part")
def q1(spark, d):
    return op.select_cols(table(spark, d, "part"), "p_partkey, p_name,p_retailprice")


@add("q2_where_eq", """
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem
WHERE l_returnflag = 'R' AND l_linestatus = 'F' AND l_linenumber = 3""")
def q2(spark, d):
    found = op.where_eq(table(spark, d, "lineitem"), "l_returnflag:R,l_linestatus:F,l_linenumber:3,l_quantity")
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@add("q3_page", """
SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 100 OFFSET 500""")
def q3(spark, d):
    return op.page(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"], 100, 500)


@add("q4_query", """
WITH f AS (SELECT * FROM lineitem WHERE l_returnflag = 'A' AND l_linestatus = 'O')
SELECT l_orderkey, l_partkey, l_quantity, (SELECT count(*) FROM f) AS total FROM f
ORDER BY l_extendedprice, l_orderkey, l_partkey, l_linenumber LIMIT 200 OFFSET 100""")
def q4(spark, d):
    rows, total = op.query(
        table(spark, d, "lineitem"), ["l_extendedprice", "l_orderkey", "l_partkey", "l_linenumber"],
        "l_orderkey,l_partkey,l_quantity", "l_returnflag:A,l_linestatus:O", 200, 100,
    )
    return rows.withColumn("total", total.scalar())


@add("q5_where_any_eq", f"""{TRANSFER_CELLS} FROM lineitem WHERE l_orderkey = 42 OR l_partkey = 42""")
def q5(spark, d):
    path = transfers(spark, d)
    header = head_lines(spark, path, 1)[0].split(",")
    accounts = op.account_columns(header, dedupe_header(header))
    return op.where_any_eq(read_text_csv(spark, path), accounts, "42")


LINE_ORDER = ["l_shipdate", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"]


@add("q6_rows_at", f"""
SELECT l_orderkey, l_partkey, l_quantity FROM lineitem ORDER BY {', '.join(LINE_ORDER)} LIMIT 1000 OFFSET 3000""")
def q6(spark, d):
    rows = op.rows_at(table(spark, d, "lineitem"), 3000, 1000, LINE_ORDER, shallow=0)
    return rows.select("l_orderkey", "l_partkey", "l_quantity")


@add("q6_rows_at_ties", """
SELECT count(*) AS "rows", strftime(min(l_shipdate), '%Y-%m-%d') AS first, strftime(max(l_shipdate), '%Y-%m-%d') AS last
FROM (SELECT l_shipdate FROM lineitem ORDER BY l_shipdate LIMIT 1000 OFFSET 3000)""")
def q6_ties(spark, d):
    rows = op.rows_at(table(spark, d, "lineitem"), 3000, 1000, ["l_shipdate"])
    day = F.date_format("l_shipdate", "yyyy-MM-dd")
    return rows.agg(F.count("*").alias("rows"), F.min(day).alias("first"), F.max(day).alias("last"))


def checked(rows, whole):
    """How many rows there are, and whether all are rows of the whole table."""
    found = rows.join(whole, rows.columns, "left_semi").agg(F.count("*"))
    return rows.agg(F.count("*").alias("rows")).select("rows", (F.col("rows") == found.scalar()).alias("all_known"))


@add("q7_head", """SELECT least(10, count(*)) AS "rows", TRUE AS all_known FROM lineitem""")
def q7(spark, d):
    keys = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return checked(durable(op.head(keys, 10)), keys)


@add("q8_sample", """SELECT TRUE AS about_a_tenth, TRUE AS all_known, count(*) AS "rows" FROM lineitem""")
def q8(spark, d):
    keys = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    found = checked(durable(op.sample(keys, 0.1, seed=7)), keys).withColumn("all", keys.agg(F.count("*")).scalar())
    near = F.abs(F.col("rows") - F.col("all") / 10) <= 5 * F.sqrt(F.col("all") * 0.09)
    return found.select(near.alias("about_a_tenth"), "all_known", F.col("all").alias("rows"))


@add("q9_find_by_attr", """
SELECT event_id, event_type FROM events WHERE props->>'k' = '7'""")
def q9(spark, d):
    return op.find_by_attr(table(spark, d, "events"), {"k": "7"}, data="props").select("event_id", "event_type")


@add("q9_find_by_attr_any", """
SELECT event_id FROM events WHERE props->>'k' = '7' OR props->>'missing' IS NOT NULL""")
def q9_any(spark, d):
    found = op.find_by_attr(table(spark, d, "events"), {"k": "7", "missing": None}, any_of=True, data="props")
    return found.select("event_id")


@add("q10_attrs", "SELECT event_id, props->>'k' AS k, props->>'none' AS nothing FROM events")
def q10(spark, d):
    return op.attrs(table(spark, d, "events"), {"k": "k", "nothing": "none"}, key="event_id", data="props")


@add("q11_sql", """
SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM nation
JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey
WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 100000 GROUP BY n_name""")
def q11(spark, d):
    tables = {n: table(spark, d, n) for n in ("nation", "customer", "orders")}
    return op.sql(spark, """
        SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM nation
        JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey
        WHERE o_orderpriority = :priority AND o_totalprice > :least GROUP BY n_name""",
        tables, {"priority": "1-URGENT", "least": 100000})


@add("q12_describe_table", """
SELECT h.*, (SELECT count(*) FROM supplier) AS row_count, 4 AS column_count
FROM (VALUES (0, 's_suppkey', 'bigint'), (1, 's_name', 'string'), (2, 's_nationkey', 'int'), (3, 's_acctbal', 'double'))
     AS h(position, name, "type")""")
def q12(spark, d):
    return op.describe_table(table(spark, d, "supplier"))


@add("q13_where", "SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice > 950.5")
def q13(spark, d):
    return op.where(table(spark, d, "part"), "p_retailprice > 950.5").select("p_partkey", "p_retailprice")
