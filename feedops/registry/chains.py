"""Chains of operators over written feed folders."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedops.operators import workflows
from feedops.operators.discovery import latest_per_dir
from feedops.operators.profile import extract_metadata
from feedops.registry.base import Registry
from feedops.registry.inputs import ORDER_FEEDS, feed_tree
from feedops.registry.merging import ORDER, target_records

REGISTRY = Registry()
add = REGISTRY.add

LAST = "QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1"
NEWEST = f"""{ORDER_FEEDS},
newest AS (SELECT feed, max(file) AS file FROM feeds GROUP BY feed)"""
FEED_COLUMNS = ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate"]


@add("f5_load_latest", f"""
WITH {NEWEST},
tgt AS (SELECT CASE WHEN c_acctbal >= 0 THEN '' ELSE 'C' END || c_custkey AS id, c_name, c_mktsegment FROM customer),
last AS (SELECT f.* FROM feeds f JOIN newest n ON f.feed = n.feed AND f.file = n.file {LAST})
SELECT id, 'c_name' AS attribute, c_name AS "value" FROM tgt UNION ALL SELECT id, 'c_mktsegment', c_mktsegment FROM tgt
{' '.join(f"UNION ALL SELECT o_custkey, '{c}', {c} FROM last" for c in FEED_COLUMNS)}
UNION ALL SELECT coalesce(id, o_custkey), 'o_orderpriority', coalesce(o_orderpriority, '0-NONE')
FROM tgt FULL OUTER JOIN last ON id = o_custkey""")
def f5_load(spark, d):
    loaded = workflows.load_latest(
        spark, feed_tree(spark, d), target_records(spark, d), "O_CUSTKEY", include="^feed=", order=ORDER
    )
    return loaded["records"].select("id", F.explode("data").alias("attribute", "value"))


@add("m12_load_latest_keys", f"""
WITH {NEWEST},
rows AS (SELECT f.* FROM feeds f JOIN newest n ON f.feed = n.feed AND f.file = n.file)
SELECT o_custkey AS "KEY", count(*) AS "COUNT", 'file=' || max(file) AS "EXISTS_IN" FROM rows GROUP BY o_custkey""")
def m12_load(spark, d):
    loaded = workflows.load_latest(spark, feed_tree(spark, d), target_records(spark, d), "o_custkey", order=ORDER)
    # every folder has its newest file under the same name
    return loaded["keys"].withColumn("EXISTS_IN", F.array_join(F.array_distinct(F.split("EXISTS_IN", ",")), ","))


@add("c9_compare_latest", f"""
WITH {ORDER_FEEDS},
done AS (SELECT *, dense_rank() OVER (ORDER BY file DESC) AS age FROM feeds WHERE feed = 'orders_F'),
curr AS (SELECT * FROM done WHERE age = 1 {LAST}), prev AS (SELECT * FROM done WHERE age = 2 {LAST}),
j AS (SELECT p.o_custkey IS NOT NULL AS had, c.o_custkey IS NOT NULL AS has,
             p.o_orderkey <> c.o_orderkey OR p.o_totalprice <> c.o_totalprice OR p.o_orderdate <> c.o_orderdate
             OR p.o_orderpriority <> c.o_orderpriority AS changed
      FROM prev p FULL OUTER JOIN curr c ON p.o_custkey = c.o_custkey)
SELECT count(*) FILTER (WHERE has) AS current_row_count, count(*) FILTER (WHERE has AND (NOT had OR changed)) AS delta_row_count,
       count(*) FILTER (WHERE has AND NOT had) AS new_records, count(*) FILTER (WHERE had AND has AND changed) AS changed_records,
       count(*) FILTER (WHERE had AND NOT has) AS removed_records FROM j""")
def c9_compare(spark, d):
    got = workflows.compare_latest(spark, f"{feed_tree(spark, d)}/feed=orders_F", "o_custkey", order=ORDER)
    return got["stats"].drop("changed_columns")


@add("e2_entities_from", f"""
WITH {NEWEST},
rows AS (SELECT f.* FROM feeds f JOIN newest n ON f.feed = n.feed AND f.file = n.file)
SELECT o_custkey, arg_max(o_orderkey, o_orderdate || ' ' || o_orderkey) AS o_orderkey FROM rows WHERE o_custkey LIKE '1%' GROUP BY o_custkey""")
def e2_chain(spark, d):
    root = feed_tree(spark, d)
    found = workflows.entities_from(
        spark, latest_per_dir(workflows.feeds_under(spark, root)), extract_metadata(spark, root), "o_custkey", ORDER, prefix="1"
    )
    return found["state"].select("o_custkey", "o_orderkey")


@add("m1_merge_latest", f"""
WITH {NEWEST},
rows AS (SELECT f.* FROM feeds f JOIN newest n ON f.feed = n.feed AND f.file = n.file)
SELECT DISTINCT o_custkey FROM rows""")
def m1_chain(spark, d):
    return workflows.merge_latest(spark, feed_tree(spark, d), "feed", "o_custkey", ORDER, keep_all_keys=True).select("o_custkey")


@add("m1_merge_latest_values", f"""
WITH {NEWEST},
rows AS (SELECT f.* FROM feeds f JOIN newest n ON f.feed = n.feed AND f.file = n.file),
top AS (SELECT feed, file FROM newest ORDER BY file DESC, feed DESC LIMIT 1),
last AS (SELECT f.* FROM feeds f JOIN top t ON f.feed = t.feed AND f.file = t.file {LAST})
SELECT k.o_custkey, l.o_orderkey, l.o_totalprice, l.o_orderdate, l.o_orderpriority
FROM (SELECT DISTINCT o_custkey FROM rows) k LEFT JOIN last l ON k.o_custkey = l.o_custkey""")
def m1_values(spark, d):
    merged = workflows.merge_latest(spark, feed_tree(spark, d), "feed", "o_custkey", ORDER, keep_all_keys=True)
    return merged.select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate", "o_orderpriority")
