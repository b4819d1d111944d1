"""Entity state and history."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedops.operators import entity as op
from feedops.registry.base import Registry, table
from feedops.registry.inputs import (
    DOCUMENT_FILES,
    NO_PRIORITY,
    ORDER_FEEDS,
    RAW_CELLS,
    document_files,
    order_feeds,
    raw_cells,
)

REGISTRY = Registry()
add = REGISTRY.add
ORDER = ["o_orderdate", "o_orderkey"]
TYPES = {"o_orderkey": "integer", "o_orderstatus": "text", "o_totalprice": "integer", "o_orderpriority": "integer"}


def entity_rows(spark, d):
    """Order feeds keyed by customer; rows in progress have a provisional id, and a
    missing priority is written as a null token."""
    feeds = order_feeds(spark, d)
    id_ = F.concat(F.when(F.col("o_orderstatus") == "P", "TMP").otherwise("BBG"), F.col("o_custkey"))
    priority = F.when(F.col("o_orderpriority") == NO_PRIORITY, "n.a.").otherwise(F.col("o_orderpriority"))
    return feeds.select(
        id_.alias("id"), "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate", priority.alias("o_orderpriority"),
        F.col("file").alias("_file"), F.concat(F.substring("o_orderdate", 1, 4), F.lit("1231")).alias("_date"),
    )


ENTITIES = f"""{ORDER_FEEDS},
ent AS (SELECT CASE WHEN o_orderstatus = 'P' THEN 'TMP' ELSE 'BBG' END || o_custkey AS id, o_orderkey, o_orderstatus,
               CAST(CAST(trunc(CAST(o_totalprice AS DOUBLE)) AS BIGINT) AS VARCHAR) AS o_totalprice, o_orderdate,
               nullif(o_orderpriority, '{NO_PRIORITY}') AS o_orderpriority, file,
               substr(o_orderdate, 1, 4) || '1231' AS day, o_orderdate || ' ' || o_orderkey AS ord FROM feeds),
valid AS (SELECT * FROM ent WHERE id LIKE 'BBG%')"""


@add("e1_valid_entities", f"WITH {ENTITIES} SELECT id, o_orderkey FROM valid")
def e1(spark, d):
    return op.valid_entities(entity_rows(spark, d), "id").select("id", "o_orderkey")


@add("e2_entity_state", f"""
WITH {ENTITIES}
SELECT id, arg_max(o_orderkey, ord) AS o_orderkey, arg_max(o_orderstatus, ord) AS o_orderstatus,
       arg_max(o_totalprice, ord) AS o_totalprice,
       arg_max(o_orderpriority, ord) FILTER (WHERE o_orderpriority IS NOT NULL) AS o_orderpriority
FROM valid GROUP BY id""")
def e2(spark, d):
    return op.entity_state(entity_rows(spark, d), "id", TYPES, ORDER)


@add("e2_entity_state_prefix", f"""
WITH {ENTITIES}
SELECT id, arg_max(o_orderkey, ord) AS o_orderkey, arg_max(o_totalprice, ord) AS o_totalprice FROM ent WHERE id LIKE 'TMP%' GROUP BY id""")
def e2_prefix(spark, d):
    return op.entity_state(entity_rows(spark, d), "id", TYPES, ORDER, prefix="TMP").select("id", "o_orderkey", "o_totalprice")


LONG = """
long AS (SELECT id, 'o_orderkey' AS property, o_orderkey AS "value", day, file, ord FROM valid
  UNION ALL SELECT id, 'o_orderstatus', o_orderstatus, day, file, ord FROM valid
  UNION ALL SELECT id, 'o_totalprice', o_totalprice, day, file, ord FROM valid
  UNION ALL SELECT id, 'o_orderpriority', o_orderpriority, day, file, ord FROM valid WHERE o_orderpriority IS NOT NULL)"""


@add("e2_entity_records", f"""
WITH {ENTITIES}, {LONG}
SELECT id, property AS attribute, arg_max("value", ord) AS "value" FROM long GROUP BY id, property""")
def e2_records(spark, d):
    records = op.entity_records(entity_rows(spark, d), "id", TYPES, ORDER)
    return records.select("id", F.explode("data").alias("attribute", "value"))


@add("e3_entity_history", f"""
WITH {ENTITIES}, {LONG}
SELECT id, property, day AS effective_date, arg_max(file, ord) AS file, arg_max("value", ord) AS "value"
FROM long GROUP BY id, property, day""")
def e3(spark, d):
    return op.entity_history(entity_rows(spark, d), "id", TYPES, ORDER)


@add("e3_history_documents", f"""
WITH {ENTITIES}, {LONG},
h AS (SELECT id, property, day, arg_max(file, ord) AS file, arg_max("value", ord) AS "value" FROM long GROUP BY id, property, day)
SELECT id, property, '{{' || string_agg('"' || day || '":{{"file":"' || file || '","value":"' || "value" || '"}}', ',' ORDER BY day)
       || '}}' AS history FROM h GROUP BY id, property""")
def e3_documents(spark, d):
    return op.history_documents(op.entity_history(entity_rows(spark, d), "id", TYPES, ORDER))


def feed_cells(spark, d):
    """Mixed cells as files: one per brand, and one column per part of the size range."""
    cells = raw_cells(spark, d)
    size, raw = F.col("p_size"), F.col("raw")
    return cells.select(
        F.col("p_brand").alias("_file"), raw.alias("mixed"), F.when(size.between(10, 25), raw).alias("numbers"),
        F.when(size.between(37, 39), raw).alias("exponents"),
    )


CELL_TYPES = {"mixed": "integer", "numbers": "integer", "exponents": "float"}
MISMATCHES = f"""{RAW_CELLS},
bad AS (SELECT DISTINCT p_brand AS filename FROM cells
        WHERE regexp_matches(raw, '[A-Za-z_]') AND lower(trim(raw)) NOT IN ('', 'n.a.', 'null', 'nil', 'none', 'n/a'))"""


@add("e4_type_mismatches", f"""
WITH {MISMATCHES} SELECT filename, 'mixed' AS "column", 'integer' AS declared_type, 'text' AS actual_type FROM bad""")
def e4(spark, d):
    return op.type_mismatches(feed_cells(spark, d), CELL_TYPES)


@add("e5_correct_metadata", f"""
WITH {MISMATCHES}, c(name, kind) AS (VALUES ('mixed', 'integer'), ('numbers', 'integer'), ('exponents', 'float'))
SELECT p_brand AS filename, count(*) AS "rowCount", name,
       CASE WHEN name = 'mixed' AND p_brand IN (SELECT filename FROM bad) THEN 'text' ELSE kind END AS data_type
FROM cells, c GROUP BY p_brand, name, kind""")
def e5(spark, d):
    cells = feed_cells(spark, d)
    declared = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(t).alias("dataType")) for n, t in CELL_TYPES.items()])
    meta = cells.groupBy(F.col("_file").alias("filename")).agg(F.count("*").alias("rowCount")).withColumn("columns", declared)
    fixed = op.correct_metadata(meta, op.type_mismatches(cells, CELL_TYPES)).withColumn("c", F.explode("columns"))
    return fixed.select("filename", "rowCount", F.col("c.name").alias("name"), F.col("c.dataType").alias("data_type"))


@add("e6_entity_inputs", f"""
WITH {DOCUMENT_FILES},
cat AS (SELECT source || '_equity' AS filename FROM documents GROUP BY source HAVING max(n_chars) > 10000)
SELECT directory, name FROM files
WHERE effective_date IS NOT NULL AND split_part(directory, '/', 3) IN (SELECT filename FROM cat)
QUALIFY row_number() OVER (PARTITION BY directory ORDER BY effective_date DESC, name DESC) = 1""")
def e6(spark, d):
    docs = table(spark, d, "documents")
    categories = docs.groupBy(F.concat("source", F.lit("_equity")).alias("filename")).agg(
        F.when(F.max("n_chars") > 10000, "asset").otherwise("company").alias("category")
    )
    return op.entity_inputs(document_files(spark, d), categories).select("directory", "name")
