"""Counts, profiles, type inference, metadata."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedops.operators import profile as op
from feedops.registry.base import Registry, table
from feedops.registry.inputs import ORDER_FEEDS, RAW_CELLS, feed_tree, raw_cells, text_orders

REGISTRY = Registry()
add = REGISTRY.add


@add("a1_row_count", "SELECT count(*) AS row_count FROM lineitem")
def a1(spark, d):
    return op.row_count(table(spark, d, "lineitem"))


@add("a2_value_counts", """
SELECT l_partkey AS "value", count(*) AS "count" FROM lineitem GROUP BY 1 HAVING count(*) >= 30""")
def a2(spark, d):
    return op.value_counts(table(spark, d, "lineitem"), "l_partkey", 30)


@add("a3_value_count_summary", """
WITH c AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS total_rows, count(*) AS unique_values, count(*) FILTER (WHERE n >= 30) AS kept_values,
       count(*) FILTER (WHERE n < 30) AS excluded_values FROM c""")
def a3(spark, d):
    return op.value_count_summary(table(spark, d, "lineitem"), "l_partkey", 30)


def _monthly(spark, d):
    events = table(spark, d, "events")
    half = F.date_format("ts", "HH") < "12"
    return [op.value_counts(events.filter(part), "user_id", ordered=False) for part in (half, ~half)]


@add("a4_merge_counts", 'SELECT user_id AS "value", count(*) AS "count" FROM events GROUP BY 1')
def a4(spark, d):
    return op.merge_counts(_monthly(spark, d))


@add("a4_merge_summary", """
SELECT 2 AS files, count(DISTINCT user_id) AS unique_values, count(*) AS total_count FROM events""")
def a4_summary(spark, d):
    return op.merge_summary(op.merge_counts(_monthly(spark, d), ordered=False), 2)


@add("a5_top_values", """
SELECT p_brand AS "value", count(*) AS "count" FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""")
def a5(spark, d):
    return op.top_values(table(spark, d, "part"), "p_brand")


def _profile(column: str, source: str) -> str:
    return f"""
SELECT '{column}' AS "column", count({column}) AS "count", round(avg({column}), 4) AS mean,
       round(stddev_samp({column}), 4) AS std, CAST(min({column}) AS DOUBLE) AS "min",
       round(quantile_cont({column}, 0.25), 4) AS q25, round(quantile_cont({column}, 0.5), 4) AS q50,
       round(quantile_cont({column}, 0.75), 4) AS q75, CAST(max({column}) AS DOUBLE) AS "max" FROM {source}"""


def _rounded(df):
    return df.select(*[F.round(c, 4).alias(c) if c in ("mean", "std", "q25", "q50", "q75") else c for c in df.columns])


@add("a6_describe", " UNION ALL ".join(_profile(c, "lineitem") for c in ("l_quantity", "l_extendedprice", "l_partkey")))
def a6(spark, d):
    return _rounded(op.describe(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_partkey"]))


@add("a6_describe_approximate", """
SELECT name AS "column", TRUE AS near FROM (VALUES ('l_quantity'), ('l_extendedprice')) AS c(name) WHERE (SELECT count(*) FROM lineitem) > 0""")
def a6_approximate(spark, d):
    """The sketch promises ranks within a ten-thousandth of the rows; the values must lie between the exact ones there."""
    lines, names = table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"]
    about = op.describe(lines, names, approximate=True)
    slack = [p + s * 0.001 for p in (0.25, 0.5, 0.75) for s in (-1, 1)]
    exact = op.quantiles(lines, names, slack).groupBy("column").agg(F.array_sort(F.collect_list("quantile")).alias("q"))
    near = [F.col(c).between(F.col("q")[2 * i], F.col("q")[2 * i + 1]) for i, c in enumerate(("q25", "q50", "q75"))]
    return about.join(exact, "column").select("column", (near[0] & near[1] & near[2]).alias("near"))


@add("a7_column_stats_numeric", f"""
SELECT *, (SELECT count(*) FROM customer) AS sample_size, CAST(1.0 AS DOUBLE) AS sample_fraction
FROM ({_profile("c_acctbal", "customer")})""")
def a7(spark, d):
    return _rounded(op.column_stats(table(spark, d, "customer"), "c_acctbal"))


@add("a7_column_stats_text", """
SELECT *, (SELECT count(*) FROM events) AS sample_size, CAST(1.0 AS DOUBLE) AS sample_fraction
FROM (SELECT event_type AS "value", count(*) AS "count" FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20)""")
def a7_text(spark, d):
    return op.column_stats(table(spark, d, "events"), "event_type")


@add("a8_infer_types", """
WITH typed(position, name, data_type) AS (VALUES (0, 'o_orderkey', 'integer'), (1, 'o_custkey', 'integer'),
  (2, 'o_orderstatus', 'text'), (3, 'o_totalprice', 'numeric'), (4, 'o_orderdate', 'date'), (5, 'o_orderpriority', 'text'))
SELECT * FROM typed WHERE (SELECT count(*) FROM orders) > 0""")
def a8(spark, d):
    return op.infer_types(text_orders(spark, d), ["o_orderdate", "o_orderkey"])


@add("a8_infer_types_all_rows", f"""
WITH {RAW_CELLS},
g AS (SELECT p_brand, CASE WHEN p_size <= 18 THEN raw END AS a, CASE WHEN p_size <= 25 THEN raw END AS b,
             CASE WHEN p_size BETWEEN 29 AND 31 THEN raw END AS c, CASE WHEN p_size BETWEEN 34 AND 36 THEN raw END AS e,
             CASE WHEN p_size BETWEEN 26 AND 28 THEN raw END AS f, CASE WHEN p_size BETWEEN 29 AND 33 THEN raw END AS g
      FROM cells),
seen AS (SELECT 'a' AS name, a AS raw FROM g UNION ALL SELECT 'b', b FROM g UNION ALL SELECT 'c', c FROM g
         UNION ALL SELECT 'e', e FROM g UNION ALL SELECT 'f', f FROM g UNION ALL SELECT 'g', g FROM g),
real AS (SELECT * FROM seen WHERE raw IS NOT NULL AND lower(raw) NOT IN ('', 'null', 'nil'))
SELECT CAST(rank() OVER (ORDER BY name) - 1 AS INTEGER) AS position, name,
       CASE WHEN bool_and(regexp_full_match(raw, '[+-]?[0-9]+')) THEN 'integer'
            WHEN bool_and(try_cast(raw AS DOUBLE) IS NOT NULL AND NOT raw LIKE ' %' ) THEN 'numeric'
            WHEN bool_and(regexp_full_match(raw, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AND try_cast(raw AS DATE) IS NOT NULL) THEN 'date'
            WHEN bool_and(regexp_full_match(raw, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}} .*') AND try_cast(raw AS TIMESTAMP) IS NOT NULL) THEN 'timestamp'
            WHEN bool_and(lower(raw) IN ('true', 'false', 't', 'f', 'yes', 'no', 'y', 'n', '1', '0')) THEN 'boolean'
            ELSE 'text' END AS data_type
FROM real GROUP BY name""")
def a8_all(spark, d):
    size, raw = F.col("p_size"), F.col("raw")
    wide = raw_cells(spark, d).select(
        F.when(size <= 18, raw).alias("a"), F.when(size <= 25, raw).alias("b"),
        F.when(size.between(29, 31), raw).alias("c"), F.when(size.between(34, 36), raw).alias("e"),
        F.when(size.between(26, 28), raw).alias("f"), F.when(size.between(29, 33), raw).alias("g"),
    )
    return op.infer_types(wide, sample=None)


@add("a9_extract_metadata", f"""
WITH {ORDER_FEEDS},
f AS (SELECT feed, file, o_orderstatus, substr(o_orderdate, 1, 4) || '1231' AS "effectiveDate", count(*) AS "rowCount"
      FROM feeds GROUP BY ALL),
c(name, kind) AS (VALUES ('o_orderkey', 'integer'), ('o_custkey', 'integer'), ('o_orderstatus', 'status'),
  ('o_totalprice', 'numeric'), ('o_orderdate', 'date'), ('o_orderpriority', 'text'))
SELECT 'feed=' || feed AS filename, 'feed=' || feed || '/file=' || file AS "relativePath", "effectiveDate", "rowCount", name,
       CASE WHEN kind <> 'status' THEN kind WHEN o_orderstatus = 'F' THEN 'boolean' ELSE 'text' END AS data_type
FROM f, c""")
def a9(spark, d):
    meta = op.extract_metadata(spark, feed_tree(spark, d))
    long = meta.withColumn("c", F.explode("columns"))
    return long.select(
        "filename", "relativePath", "effectiveDate", "rowCount", F.col("c.name").alias("name"),
        F.col("c.dataType").alias("data_type"),
    )


def document_meta(spark, d):
    """Metadata with one file per document; the columns depend on its language."""
    docs = table(spark, d, "documents")
    cols = lambda *names: F.array(*[F.struct(F.lit(n).alias("name"), F.lit("text").alias("dataType")) for n in names])
    lang = F.col("lang")
    columns = (
        F.when(lang == "en", cols("NAME", "ID_BB_GLOBAL")).when(lang == "de", cols("ID_BB_COMPANY", "NAME"))
        .when(lang == "fr", cols("ID_BB_COMPANY", "ID_BB_GLOBAL")).otherwise(cols("NAME"))
    )
    return docs.select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("filename"), columns.alias("columns"))


CATEGORIES = """
SELECT 'doc' || CAST(doc_id AS VARCHAR) AS filename,
       CASE WHEN lang IN ('en', 'fr') THEN 'asset' WHEN lang = 'de' THEN 'company' ELSE 'exception' END AS category FROM documents"""


@add("a10_categorise", CATEGORIES)
def a10(spark, d):
    return op.categorise(document_meta(spark, d))


@add("a10_category_counts", f"SELECT category, count(*) AS files FROM ({CATEGORIES}) GROUP BY category")
def a10_counts(spark, d):
    return op.category_counts(op.categorise(document_meta(spark, d)))
