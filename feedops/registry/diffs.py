"""Snapshot diff."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedops.functions.values import clean_cell
from feedops.operators import diff as op
from feedops.registry.base import Registry, table
from feedops.registry.inputs import CELLS, snapshots

REGISTRY = Registry()
add = REGISTRY.add
KEY = "o_orderkey"

CLASSES = f"""{CELLS},
classes AS (
  SELECT coalesce(p.o_orderkey, c.o_orderkey) AS o_orderkey,
         CASE WHEN p.o_orderkey IS NULL THEN 'new' WHEN c.o_orderkey IS NULL THEN 'deleted'
              WHEN s.key IS NOT NULL THEN 'modified' ELSE 'unchanged' END AS status
  FROM prev p FULL OUTER JOIN curr c ON p.o_orderkey = c.o_orderkey
  LEFT JOIN (SELECT DISTINCT key FROM changed_strict) s ON s.key = c.o_orderkey)"""

LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]
LINE_COLUMNS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag"]


@add("c1_last_per_key", f"""
SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(c + ' DESC' for c in LINE_ORDER)}) = 1""")
def c1(spark, d):
    return op.last_per_key(table(spark, d, "lineitem"), "l_orderkey", LINE_ORDER, LINE_COLUMNS)


@add("c2_fingerprint", f"WITH {CLASSES} SELECT status, count(*) AS keys FROM classes GROUP BY status")
def c2(spark, d):
    return op.classify(*snapshots(spark, d), KEY, op.UNIQUE).groupBy("status").agg(F.count("*").alias("keys"))


@add("c2_fingerprint_columns", f"""
WITH {CELLS}, hit AS (SELECT DISTINCT key FROM changed_strict WHERE "column" IN ('o_orderstatus', 'o_totalprice'))
SELECT CASE WHEN h.key IS NULL THEN 'unchanged' ELSE 'modified' END AS status, count(*) AS keys
FROM pairs b LEFT JOIN hit h ON b.key = h.key GROUP BY 1""")
def c2_columns(spark, d):
    found = op.classify(*snapshots(spark, d), KEY, op.UNIQUE, columns=["o_orderstatus", "o_totalprice"])
    return found.filter("status in ('modified', 'unchanged')").groupBy("status").agg(F.count("*").alias("keys"))


@add("c3_classify", f"WITH {CLASSES} SELECT * FROM classes")
def c3(spark, d):
    return op.classify(*snapshots(spark, d), KEY, op.UNIQUE)



@add("c4_split_changes", f"""
WITH {CLASSES}
SELECT c.*, status FROM curr c JOIN classes k ON c.o_orderkey = k.o_orderkey WHERE status IN ('new', 'modified')
UNION ALL SELECT p.*, status FROM prev p JOIN classes k ON p.o_orderkey = k.o_orderkey WHERE status = 'deleted'""")
def c4(spark, d):
    return op.split_changes(*snapshots(spark, d), KEY, op.UNIQUE)["all"]


@add("c4_split_changes_keys", f"WITH {CLASSES} SELECT o_orderkey FROM classes WHERE status = 'deleted'")
def c4_keys(spark, d):
    return op.split_changes(*snapshots(spark, d), KEY, op.UNIQUE, keys_only=True)["deleted"]


@add("c5_cell_changes", f"WITH {CELLS} SELECT * FROM changed")
def c5(spark, d):
    return op.cell_changes(*snapshots(spark, d), KEY, op.UNIQUE)


@add("c6_cell_changes_strict", f"WITH {CELLS} SELECT * FROM changed_strict")
def c6(spark, d):
    return op.cell_changes(*snapshots(spark, d), KEY, op.UNIQUE, nulls="strict")


@add("c7_change_documents", f"""
WITH {CELLS}
SELECT key, '{{' || string_agg('"' || "column" || '":{{"column":"' || "column" || '","previous_value":"' || previous_value ||
       '","current_value":"' || current_value || '"}}', ',' ORDER BY "column") || '}}' AS changes
FROM changed GROUP BY key""")
def c7(spark, d):
    return op.change_documents(op.cell_changes(*snapshots(spark, d), KEY, op.UNIQUE))


@add("c8_delta_rows", f"""
WITH {CELLS}
SELECT * FROM curr WHERE o_orderkey NOT IN (SELECT o_orderkey FROM prev) OR o_orderkey IN (SELECT key FROM changed)""")
def c8(spark, d):
    return op.delta_rows(*snapshots(spark, d), KEY, op.UNIQUE)


@add("c8_delta_rows_strict", f"""
WITH {CELLS}
SELECT * FROM curr WHERE o_orderkey NOT IN (SELECT o_orderkey FROM prev) OR o_orderkey IN (SELECT key FROM changed_strict)""")
def c8_strict(spark, d):
    return op.delta_rows(*snapshots(spark, d), KEY, op.UNIQUE, nulls="strict")


def _stats(changed: str) -> str:
    return f"""
WITH {CELLS},
n AS (SELECT (SELECT count(*) FROM curr) AS current_row_count,
             (SELECT count(*) FROM curr WHERE o_orderkey NOT IN (SELECT o_orderkey FROM prev)) AS new_records,
             (SELECT count(DISTINCT key) FROM {changed}) AS changed_records,
             (SELECT count(*) FROM prev WHERE o_orderkey NOT IN (SELECT o_orderkey FROM curr)) AS removed_records,
             (SELECT string_agg(DISTINCT "column", ',' ORDER BY "column") FROM {changed}) AS changed_columns)
SELECT current_row_count, new_records + changed_records AS delta_row_count, new_records, changed_records, removed_records,
       changed_columns FROM n"""


def _flat(stats):
    return stats.withColumn("changed_columns", F.array_join("changed_columns", ","))


@add("c9_diff_stats", _stats("changed"))
def c9(spark, d):
    return _flat(op.diff_stats(*snapshots(spark, d), KEY, op.UNIQUE))


@add("c9_diff_stats_strict", _stats("changed_strict"))
def c9_strict(spark, d):
    return _flat(op.diff_stats(*snapshots(spark, d), KEY, op.UNIQUE, nulls="strict"))


def line_snapshots(spark, d):
    """``lineitem`` shipped up to 1998 and up to the end: many rows per order, the last counts."""
    lines = table(spark, d, "lineitem").select(*LINE_COLUMNS, "l_shipdate", "l_extendedprice")
    return lines.filter("l_shipdate < DATE '1999-01-01'"), lines


@add("c9_diff_stats_repeated_keys", f"""
WITH old AS (SELECT * FROM lineitem WHERE l_shipdate < DATE '1999-01-01'
             QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(c + ' DESC' for c in LINE_ORDER)}) = 1),
now AS (SELECT * FROM lineitem
        QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(c + ' DESC' for c in LINE_ORDER)}) = 1),
j AS (SELECT o.l_orderkey IS NOT NULL AS had, n.l_orderkey IS NOT NULL AS has,
             o.l_partkey <> n.l_partkey OR o.l_suppkey <> n.l_suppkey OR o.l_quantity <> n.l_quantity
             OR o.l_linenumber <> n.l_linenumber OR o.l_returnflag <> n.l_returnflag AS changed
      FROM old o FULL OUTER JOIN now n ON o.l_orderkey = n.l_orderkey)
SELECT count(*) FILTER (WHERE has) AS current_row_count, count(*) FILTER (WHERE has AND (NOT had OR changed)) AS delta_row_count,
       count(*) FILTER (WHERE has AND NOT had) AS new_records, count(*) FILTER (WHERE had AND has AND changed) AS changed_records,
       count(*) FILTER (WHERE had AND NOT has) AS removed_records FROM j""")
def c9_repeated(spark, d):
    stats = op.diff_stats(
        *line_snapshots(spark, d), "l_orderkey", order=LINE_ORDER, ignore=["l_shipdate", "l_extendedprice"]
    )
    return stats.drop("changed_columns")


WHOLE_ROW = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_shipdate", "l_extendedprice"]
LARGEST = f"""
WITH old AS (SELECT * FROM lineitem WHERE l_shipdate < DATE '1999-01-01'
             QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(c + ' DESC' for c in WHOLE_ROW)}) = 1),
now AS (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(c + ' DESC' for c in WHOLE_ROW)}) = 1),
j AS (SELECT CAST(coalesce(o.l_orderkey, n.l_orderkey) AS VARCHAR) AS l_orderkey, o.l_orderkey IS NOT NULL AS had, n.l_orderkey IS NOT NULL AS has,
             {' OR '.join(f'o.{c} <> n.{c}' for c in WHOLE_ROW)} AS changed
      FROM old o FULL OUTER JOIN now n ON o.l_orderkey = n.l_orderkey)"""


@add("c3_classify_repeated_keys", f"""{LARGEST}
SELECT l_orderkey, CASE WHEN NOT had THEN 'new' WHEN NOT has THEN 'deleted' WHEN changed THEN 'modified' ELSE 'unchanged' END AS status FROM j""")
def c3_repeated(spark, d):
    return op.classify(*line_snapshots(spark, d), "l_orderkey")


PRINTED = ["l_linenumber", "l_partkey", "l_returnflag", "l_suppkey"]
PRINT = "md5(" + " || ".join(f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in PRINTED) + ")"


@add("c3_classify_by_print", f"""
WITH old AS (SELECT l_orderkey, max({PRINT}) AS print FROM lineitem WHERE l_shipdate < DATE '1999-01-01' GROUP BY l_orderkey),
now AS (SELECT l_orderkey, max({PRINT}) AS print FROM lineitem GROUP BY l_orderkey)
SELECT CAST(coalesce(o.l_orderkey, n.l_orderkey) AS VARCHAR) AS l_orderkey,
       CASE WHEN o.l_orderkey IS NULL THEN 'new' WHEN n.l_orderkey IS NULL THEN 'deleted' WHEN o.print <> n.print THEN 'modified'
            ELSE 'unchanged' END AS status
FROM old o FULL OUTER JOIN now n ON o.l_orderkey = n.l_orderkey""")
def c3_by_print(spark, d):
    """Repeated keys of which the row with the largest fingerprint counts."""
    return op.classify(*(s.select("l_orderkey", *PRINTED) for s in line_snapshots(spark, d)), "l_orderkey", op.BY_PRINT)


@add("c9_diff_stats_without_order", f"""{LARGEST}
SELECT count(*) FILTER (WHERE has) AS current_row_count, count(*) FILTER (WHERE has AND (NOT had OR changed)) AS delta_row_count,
       count(*) FILTER (WHERE has AND NOT had) AS new_records, count(*) FILTER (WHERE had AND has AND changed) AS changed_records,
       count(*) FILTER (WHERE had AND NOT has) AS removed_records FROM j""")
def c9_without_order(spark, d):
    return op.diff_stats(*line_snapshots(spark, d), "l_orderkey").drop("changed_columns")


@add("c7_change_documents_repeated_keys", f"""{LARGEST} SELECT count(*) AS documents FROM j WHERE had AND has AND changed""")
def c7_repeated(spark, d):
    cells = op.cell_changes(*line_snapshots(spark, d), "l_orderkey")
    return op.change_documents(cells).agg(F.count("changes").alias("documents"))


@add("c10_default_ignore", f"""
WITH {CELLS} SELECT "column", count(*) AS cells FROM changed WHERE "column" <> 'o_totalprice' GROUP BY 1""")
def c10(spark, d):
    cells = op.cell_changes(*snapshots(spark, d), KEY, op.UNIQUE, ignore=["o_totalprice"])
    return cells.groupBy("column").agg(F.count("*").alias("cells"))


ANNOTATED = f"""
WITH {CELLS},
delta AS (SELECT * FROM curr WHERE o_orderkey NOT IN (SELECT o_orderkey FROM prev) OR o_orderkey IN (SELECT key FROM changed))
SELECT o_orderkey, o_orderstatus AS status_value, 'Previous: ' || s.previous_value AS status_note,
       s.key IS NOT NULL AS status_changed, o_totalprice AS price_value, 'Previous: ' || t.previous_value AS price_note,
       t.key IS NOT NULL AS price_changed
FROM delta LEFT JOIN changed s ON s.key = o_orderkey AND s."column" = 'o_orderstatus'
           LEFT JOIN changed t ON t.key = o_orderkey AND t."column" = 'o_totalprice'"""


def _notes(noted):
    return noted.select(
        KEY,
        F.col("o_orderstatus.value").alias("status_value"), F.col("o_orderstatus.previous").alias("status_note"),
        F.col("o_orderstatus.changed").alias("status_changed"), F.col("o_totalprice.value").alias("price_value"),
        F.col("o_totalprice.previous").alias("price_note"), F.col("o_totalprice.changed").alias("price_changed"),
    )


@add("c12_annotate_changes", ANNOTATED)
def c12(spark, d):
    prev, curr = snapshots(spark, d)
    return _notes(op.annotate_changes(op.delta_rows(prev, curr, KEY, op.UNIQUE), op.cell_changes(prev, curr, KEY, op.UNIQUE), KEY))


@add("c12_annotated_delta", ANNOTATED)
def c12_delta(spark, d):
    return _notes(op.annotated_delta(*snapshots(spark, d), KEY, op.UNIQUE, columns=["o_orderstatus", "o_totalprice"]))


@add("c13_match_ids", """
WITH keys AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS key FROM orders),
a AS (SELECT key, l_orderkey, l_linenumber, l_partkey FROM keys JOIN lineitem ON CAST(l_suppkey AS VARCHAR) = key),
b AS (SELECT key, l_orderkey, l_linenumber, l_partkey FROM keys JOIN lineitem ON CAST(l_partkey AS VARCHAR) = key
      WHERE key NOT IN (SELECT CAST(l_suppkey AS VARCHAR) FROM lineitem))
SELECT key, id_column, count(*) AS "rows" FROM
  (SELECT key, 'l_suppkey' AS id_column FROM a UNION ALL SELECT key, 'l_partkey' FROM b) GROUP BY key, id_column""")
def c13(spark, d):
    keys = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("key"))
    found = op.match_ids(table(spark, d, "lineitem"), keys, "l_orderkey", ["l_suppkey", "l_missing", "l_partkey"])
    return found.groupBy("key", "id_column").agg(F.count("*").alias("rows"))


@add("c14_clean_cell", r"""
SELECT page_id, CASE WHEN html = '' THEN ' '
       ELSE substr(regexp_replace(html, '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g'), 1, 32000) END AS cell FROM pages""")
def c14(spark, d):
    return table(spark, d, "pages").select("page_id", clean_cell("html", most=32_000).alias("cell"))


@add("c14_clean_cell_whole", r"""
SELECT doc_id, CASE WHEN text = '' THEN ' ' ELSE regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g') END AS cell FROM documents""")
def c14_whole(spark, d):
    return table(spark, d, "documents").select("doc_id", clean_cell("text").alias("cell"))


