"""Obfuscation and cell transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedops.functions.values import convert, is_null_token, prefix_path, sanitize_name
from feedops.operators.mask import obfuscate
from feedops.registry.base import Registry, table
from feedops.registry.inputs import DOCUMENT_FILES, RAW_CELLS, document_files, raw_cells
from feedops.session import durable

REGISTRY = Registry()
add = REGISTRY.add


@add("t1_obfuscate_hash", "SELECT c_custkey, sha256(c_name) AS c_name, sha256(c_mktsegment) AS c_mktsegment FROM customer")
def t1(spark, d):
    customers = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return obfuscate(customers, ["c_name", "c_mktsegment"], "hash")


@add("t2_obfuscate_random", """
SELECT c_custkey, length(c_name) AS n, TRUE AS letters_and_digits, TRUE AS changed FROM customer""")
def t2(spark, d):
    customers = table(spark, d, "customer").select("c_custkey", "c_name")
    names = customers.withColumnRenamed("c_name", "plain")
    both = obfuscate(customers, ["c_name"], "random", seed=3).join(names, "c_custkey")
    return both.select(
        "c_custkey", F.length("c_name").cast("bigint").alias("n"),
        F.col("c_name").rlike("^[A-Za-z0-9]*$").alias("letters_and_digits"), (F.col("c_name") != F.col("plain")).alias("changed"),
    )


def _mask(c: str) -> str:
    return f"CASE WHEN length({c}) <= 2 THEN {c} ELSE substr({c}, 1, 1) || repeat('*', length({c}) - 2) || substr({c}, -1, 1) END"


@add("t3_obfuscate_mask", f"SELECT doc_id, {_mask('lang')} AS lang, {_mask('text')} AS text FROM documents")
def t3(spark, d):
    return obfuscate(table(spark, d, "documents").select("doc_id", "lang", "text"), ["lang", "text"], "mask")


@add("t4_obfuscate_max_rows", """SELECT least(100, count(*)) AS "rows", 0 AS plain_names, TRUE AS all_known FROM customer""")
def t4(spark, d):
    customers = table(spark, d, "customer").select("c_custkey", "c_name")
    rows = durable(obfuscate(customers, ["c_name"], "unheard-of", max_rows=100))
    known = rows.join(customers, "c_custkey", "left_semi").count()
    plain = rows.join(customers.select(F.col("c_name")), "c_name", "left_semi").count()
    return rows.agg(F.count("*").alias("rows"), F.lit(plain).alias("plain_names"), (F.count("*") == known).alias("all_known"))


@add("t5_is_null_token", f"""
WITH {RAW_CELLS} SELECT p_partkey, lower(trim(raw)) IN ('', 'n.a.', 'null', 'nil', 'none', 'n/a') AS missing FROM cells""")
def t5(spark, d):
    return raw_cells(spark, d).select("p_partkey", is_null_token("raw").alias("missing"))


CONVERTED = f"""{RAW_CELLS},
kinds(declared) AS (VALUES ('integer'), ('float'), ('text'), ('date')),
x AS (SELECT p_partkey, raw, declared, lower(trim(raw)) IN ('', 'n.a.', 'null', 'nil', 'none', 'n/a') AS missing,
             regexp_full_match(raw, '[+-]?[0-9]+') AS whole,
             regexp_full_match(raw, '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?') AS number,
             regexp_matches(raw, '[A-Za-z_]') AS lettered FROM cells, kinds),
k AS (SELECT *, CASE WHEN missing THEN 'null' WHEN declared = 'text' THEN 'text'
               WHEN declared = 'integer' THEN CASE WHEN whole THEN 'integer' WHEN lettered THEN 'text' WHEN number THEN 'cut' ELSE 'invalid' END
               WHEN declared = 'float' THEN CASE WHEN number THEN 'float' WHEN lettered THEN 'text' ELSE 'invalid' END
               ELSE CASE WHEN whole THEN 'integer' WHEN number THEN 'float' ELSE 'text' END END AS kind FROM x)"""


@add("t6_convert", f"""
WITH {CONVERTED}
SELECT p_partkey, declared, CASE kind WHEN 'integer' THEN CAST(try_cast(raw AS BIGINT) AS VARCHAR)
         WHEN 'cut' THEN CAST(CAST(trunc(try_cast(raw AS DOUBLE)) AS BIGINT) AS VARCHAR)
         WHEN 'null' THEN NULL WHEN 'invalid' THEN NULL ELSE raw END AS "value",
       CASE kind WHEN 'cut' THEN 'integer' ELSE kind END AS "type", kind <> 'invalid' AS ok FROM k""")
def t6(spark, d):
    kinds = F.explode(F.array(*[F.lit(k) for k in ("integer", "float", "text", "date")]))
    cells = raw_cells(spark, d).withColumn("declared", kinds)
    return cells.select("p_partkey", "declared", convert("raw", "declared").alias("v")).select("p_partkey", "declared", "v.*")


@add("t7_prefix_path", "SELECT c_custkey, array_to_string(string_split(c_name, ''), '/') AS path FROM customer")
def t7(spark, d):
    return table(spark, d, "customer").select("c_custkey", prefix_path("c_name").alias("path"))


@add("t8_sanitize_name", f"""
WITH {DOCUMENT_FILES}
SELECT path, regexp_replace(regexp_replace(regexp_replace(path, '[.][^.]*$', ''), '[^a-zA-Z0-9]+', '_', 'g'),
       '^_+|_+$', '', 'g') AS clean FROM files""")
def t8(spark, d):
    return document_files(spark, d).select("path", sanitize_name("path").alias("clean"))
