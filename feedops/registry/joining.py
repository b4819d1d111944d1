"""Joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedops.operators import joins as op
from feedops.operators.query import select_cols
from feedops.registry.base import Registry, table

REGISTRY = Registry()
add = REGISTRY.add


def catalog(spark, d, *names):
    return {n: table(spark, d, n) for n in names}


@add("j1_join_tables", """
SELECT * FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey""")
def j1(spark, d):
    return op.join_tables(
        catalog(spark, d, "nation", "customer", "orders"), ["nation", "customer", "orders"],
        [("nation", "n_nationkey", "customer", "c_nationkey"), ("orders", "o_custkey", "customer", "c_custkey")],
    )


@add("j1_join_tables_spread", """
SELECT l_orderkey, l_linenumber, l_returnflag, s_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey""")
def j1_spread(spark, d):
    joined = op.join_tables(
        catalog(spark, d, "lineitem", "supplier"), ["lineitem", "supplier"],
        [("lineitem", "l_suppkey", "supplier", "s_suppkey")], slices=8,
    )
    return select_cols(joined, ["l_orderkey", "l_linenumber", "l_returnflag", "s_name"])


@add("j1_join_tables_spread_hot", """
SELECT event_id, e.event_type, users FROM events e
JOIN (SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY event_type) t ON e.event_type = t.event_type""")
def j1_hot(spark, d):
    events = table(spark, d, "events").select("event_id", "event_type")
    kinds = table(spark, d, "events").groupBy("event_type").agg(F.countDistinct("user_id").alias("users"))
    return op.spread_join(events, kinds, "event_type", slices=8).select("event_id", "event_type", "users")


@add("j3_filter_shared", """
SELECT o_orderkey, o_totalprice, l_linenumber, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey
WHERE o_orderstatus = 'F' AND l_linestatus = 'F'""")
def j3(spark, d):
    tables = catalog(spark, d, "orders", "lineitem")
    tables["orders"] = tables["orders"].withColumnRenamed("o_orderstatus", "status")
    tables["lineitem"] = tables["lineitem"].withColumnRenamed("l_linestatus", "STATUS")
    kept = op.filter_shared(tables, ["orders", "lineitem"], {"Status": "F"})
    joined = op.join_tables(kept, ["orders", "lineitem"], [("orders", "o_orderkey", "lineitem", "l_orderkey")])
    return joined.select("o_orderkey", "o_totalprice", "l_linenumber", "l_quantity")


@add("j4_semi_reduce", """
SELECT l_returnflag, count(*) AS "lines", round(sum(l_quantity), 2) AS quantity FROM lineitem
WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (
        SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)))
GROUP BY l_returnflag""")
def j4(spark, d):
    small = table(spark, d, "nation").filter("n_regionkey = 2")
    customers = op.semi_reduce(small, table(spark, d, "customer"), ("n_nationkey", "c_nationkey"))
    orders = op.semi_reduce(customers, table(spark, d, "orders"), ("c_custkey", "o_custkey"))
    lines = op.semi_reduce(orders, table(spark, d, "lineitem"), ("o_orderkey", "l_orderkey"))
    return lines.groupBy("l_returnflag").agg(
        F.count("*").alias("lines"), F.round(F.sum("l_quantity"), 2).alias("quantity")
    )


@add("j5_join_limited", """
SELECT o_orderkey, o_totalprice, l_linenumber, l_partkey, l_quantity
FROM (SELECT * FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 50) JOIN lineitem ON l_orderkey = o_orderkey""")
def j5(spark, d):
    joined = op.join_limited(
        catalog(spark, d, "orders", "lineitem"), ["orders", "lineitem"],
        [("orders", "o_orderkey", "lineitem", "l_orderkey")], 50, ["o_totalprice", "o_orderkey"],
    )
    return joined.select("o_orderkey", "o_totalprice", "l_linenumber", "l_partkey", "l_quantity")


URGENT = "SELECT CASE WHEN o_orderpriority = '1-URGENT' AND o_totalprice > 200000 THEN o_custkey ELSE -o_custkey - 1 END FROM orders"


def urgent(spark, d):
    """A master key per order: the customer's for large urgent ones, else one that no customer has."""
    wanted = F.expr("o_orderpriority = '1-URGENT' AND o_totalprice > 200000")
    return table(spark, d, "orders").select(F.when(wanted, F.col("o_custkey")).otherwise(-F.col("o_custkey") - 1).alias("o_custkey"))


@add("j7_missing_keys", f"""
SELECT DISTINCT o_custkey AS custkey FROM orders WHERE o_custkey NOT IN ({URGENT})""")
def j7(spark, d):
    staged = table(spark, d, "orders").select(F.col("o_custkey").alias("custkey"))
    return op.missing_keys(staged, urgent(spark, d), "custkey", "o_custkey")


@add("j8_missing_summary", f"""
SELECT 'temp_customers' AS table_name, count(DISTINCT c_custkey) AS missing FROM customer WHERE c_custkey NOT IN ({URGENT})
UNION ALL SELECT 'temp_orders', count(DISTINCT o_custkey) FROM orders WHERE o_custkey NOT IN ({URGENT})
UNION ALL SELECT 'temp_urgent', 0""")
def j8(spark, d):
    staged = {
        "temp_customers": table(spark, d, "customer").select(F.col("c_custkey").alias("CUSTKEY")),
        "temp_orders": table(spark, d, "orders").select(F.col("o_custkey").alias("custkey")),
        "temp_urgent": urgent(spark, d).withColumnRenamed("o_custkey", "custkey"),
    }
    return op.missing_summary(staged, urgent(spark, d), "custkey", "o_custkey")


@add("j10_merged_rows", f"""
SELECT c_custkey, c_name FROM customer WHERE c_custkey IN ({URGENT})""")
def j10(spark, d):
    found = op.merged_rows(table(spark, d, "customer"), urgent(spark, d), "o_custkey", "c_custkey")
    return found.select("c_custkey", "c_name")


@add("j10_merged_count", f"SELECT count(*) AS merged FROM customer WHERE c_custkey IN ({URGENT})")
def j10_count(spark, d):
    found = op.merged_rows(table(spark, d, "customer"), urgent(spark, d), "o_custkey", "c_custkey")
    return found.agg(F.count("*").alias("merged"))
