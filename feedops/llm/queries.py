"""The operators run on whole tables: ``QUERIES`` and, where SQL can express one, ``ORACLE``."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedops.llm import bpe, centroids, chats, codes, decontam, langid, pages, pii, quality, simhash, toxicity, urls, vectors

VOCABULARY = "byte_bpe_50k.tiktoken"

QUERIES = {}
ORACLE = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def put(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return put


@query("op1_language_id")
def language(spark: SparkSession, folder: str) -> DataFrame:
    return langid.identify(table(spark, folder, "documents"))


RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]

REPUTATION_SQL = """
WITH cut AS (
  SELECT page_id, url, coalesce(strpos(url, '://'), 0) AS i FROM pages
), parts AS (
  SELECT page_id,
         CASE WHEN i > 0 THEN translate(regexp_extract(substr(url, i + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
         CASE WHEN i > 0 THEN regexp_extract(substr(url, i + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM cut
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/en/1%' THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/es/%' THEN 'example.org/es/'
    WHEN host LIKE '%.com' AND path LIKE '/de/%' OR host = 'com' AND path LIKE '/de/%' THEN 'com/de/'
    WHEN host LIKE '%.com' AND path LIKE '/fr/%' OR host = 'com' AND path LIKE '/fr/%' THEN 'com/fr/'
    WHEN (host LIKE '%.org' OR host = 'org') AND path LIKE '/%' THEN 'org/' END AS rule
  FROM parts
), labelled AS (
  SELECT host, count(*)::DOUBLE AS n, sum(CASE WHEN rule IN ('org/', 'com/fr/') THEN 0 ELSE 1 END)::DOUBLE AS k
  FROM ruled WHERE rule IS NOT NULL AND host <> '' GROUP BY host
), hosts AS (
  SELECT *, regexp_extract(host, '[^.]*$') AS suffix, regexp_extract(host, '([^.]*[.])?[^.]*$') AS domain FROM labelled
), whole AS (
  SELECT (coalesce(sum(k), 0) + 1) / (coalesce(sum(n), 0) + 2) AS mean, coalesce(sum(n), 0) + 2 AS weight FROM hosts
), s0 AS (
  SELECT suffix, sum(n) AS n, sum(k) AS k, any_value(mean) AS parent FROM hosts, whole GROUP BY suffix
), s1 AS (
  SELECT 1 / least(greatest(coalesce((sum((k - n * parent) ** 2) - sum(n * parent * (1 - parent))) / nullif(sum(n * (n - 1) * parent * (1 - parent)), 0), 0.001), 0.001), 0.999) - 1 AS m FROM s0
), suffixes AS (
  SELECT suffix, (k + m * parent) / (n + m) AS mean, n + m AS weight FROM s0, s1
), d0 AS (
  SELECT domain, sum(n) AS n, sum(k) AS k, any_value(mean) AS parent FROM hosts JOIN suffixes USING (suffix) GROUP BY domain
), d1 AS (
  SELECT 1 / least(greatest(coalesce((sum((k - n * parent) ** 2) - sum(n * parent * (1 - parent))) / nullif(sum(n * (n - 1) * parent * (1 - parent)), 0), 0.001), 0.001), 0.999) - 1 AS m FROM d0
), domains AS (
  SELECT domain, (k + m * parent) / (n + m) AS mean, n + m AS weight FROM d0, d1
), h0 AS (
  SELECT host, n, k, mean AS parent FROM hosts JOIN domains USING (domain)
), h1 AS (
  SELECT 1 / least(greatest(coalesce((sum((k - n * parent) ** 2) - sum(n * parent * (1 - parent))) / nullif(sum(n * (n - 1) * parent * (1 - parent)), 0), 0.001), 0.001), 0.999) - 1 AS m FROM h0
), by_host AS (
  SELECT host, (k + m * parent) / (n + m) AS mean, n + m AS weight FROM h0, h1
)
SELECT page_id, r.host, path, rule,
       CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN coalesce(b.mean, d.mean, s.mean, w.mean) - 1.645 * sqrt(coalesce(b.mean, d.mean, s.mean, w.mean) * (1 - coalesce(b.mean, d.mean, s.mean, w.mean)) / (coalesce(b.weight, d.weight, s.weight, w.weight) + 1)) >= 0.5 THEN 'block'
            ELSE 'allow' END AS verdict
FROM ruled r LEFT JOIN by_host b ON r.host = b.host LEFT JOIN domains d ON regexp_extract(r.host, '([^.]*[.])?[^.]*$') = d.domain
LEFT JOIN suffixes s ON regexp_extract(r.host, '[^.]*$') = s.suffix, whole w
"""


@query("op3_host_reputation", REPUTATION_SQL)
def host_reputation(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge(table(spark, folder, "pages"), RULES)


DECONTAMINATION_SQL = """
WITH item_words AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL
), windows AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM item_words WHERE len(w) > 0)
), doc_words AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents
), hits AS (
  SELECT r, i, d.n, item
  FROM (SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS win
        FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc_words, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)) d
  JOIN windows b ON d.win = b.win AND d.n = b.n
), hit_words AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r
), hit_items AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN hit_words USING (r) LEFT JOIN hit_items USING (r)
"""


@query("op4_decontamination", DECONTAMINATION_SQL)
def decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontam.scan(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op5_simhash")
def near_copies(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_copies(table(spark, folder, "documents"))


@query("op6_byte_bpe")
def byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.digests(table(spark, folder, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


@query("op10_surrogates")
def surrogates(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return pii.replace(docs, key=b"a key of the corpus")


@query("op7_main_text")
def main_text(spark: SparkSession, folder: str) -> DataFrame:
    return pages.extract(table(spark, folder, "pages"))


@query("op9_quality")
def text_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return quality.score(docs, quality.train(docs, table(spark, folder, "labels")))


VECTORS_SQL = """
WITH RECURSIVE rows AS (
  SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
), sound AS (
  SELECT vec_id, x FROM rows
  WHERE x IS NOT NULL AND len(list_filter(x, lambda v: v IS NULL OR NOT isfinite(v))) = 0 AND len(list_filter(x, lambda v: v <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b
  ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.9
), reach(node, low) AS (
  SELECT vec_id, vec_id FROM rows UNION SELECT l.b, r.low FROM reach r JOIN links l ON l.a = r.node
), component AS (
  SELECT node, min(low) AS component_id FROM reach GROUP BY node
), counts AS (
  SELECT a, count(*) AS n_links FROM links GROUP BY a
)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM rows JOIN component ON node = vec_id LEFT JOIN counts ON a = vec_id
"""


@query("op2_collision_counting", VECTORS_SQL)
def near_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.near_copies(table(spark, folder, "embeddings"))


SCHEMAS = {
    "ask": {"required": ["question"], "properties": {"question": "string", "words": "integer", "context": "string"}},
    "search": {"required": ["question", "limit"], "properties": {"question": "string", "words": "integer", "limit": "integer"}},
}

CHAT_SQL = """
WITH turns AS (
  SELECT conv_id, turn, role, text, length(text) - length(replace(text, ' ', '')) + 1 AS words, 'c' || conv_id || '-' || turn AS own,
         'c' || conv_id || '-' || (turn - 1) AS before, CASE WHEN turn > 1 THEN 'c' || conv_id || '-' || (turn % 2) END AS need
  FROM conversations
), found AS (
  SELECT conv_id, turn, CASE role WHEN 'user' THEN 1 ELSE 0 END AS place, CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'message' END AS kind,
         CASE role WHEN 'user' THEN own WHEN 'assistant' THEN before END AS id, CASE role WHEN 'user' THEN need END AS need,
         CASE role WHEN 'user' THEN words <= 30 END AS valid,
         CASE role
           WHEN 'user' THEN '{"role":"assistant","tool_call":{"arguments":{' || coalesce('"context":{"$result":"' || need || '"},', '') || '"question":' || to_json(text)::VARCHAR || ',"words":' || words || '},"id":"' || own || '","name":"' || CASE WHEN words <= 30 THEN 'ask' ELSE 'search' END || '"}}'
           WHEN 'assistant' THEN '{"content":' || to_json(text)::VARCHAR || ',"role":"tool","tool_call_id":"' || before || '"}'
           ELSE '{"content":' || to_json(text)::VARCHAR || ',"role":"' || role || '"}' END AS json
  FROM turns
), calls AS (
  SELECT c.id, c.turn, CASE WHEN c.need IS NULL THEN 0 WHEN n.id IS NOT NULL AND n.need IS NULL THEN 1 END AS level
  FROM found c LEFT JOIN found n ON n.kind = 'call' AND n.id = c.need WHERE c.kind = 'call'
), joined AS (
  SELECT f.*, c.turn AS call_turn, c.level, c.id IS NOT NULL AS has_call, r.id IS NOT NULL AS has_result
  FROM found f LEFT JOIN calls c ON c.id = f.id LEFT JOIN found r ON r.kind = 'result' AND r.id = f.id
), stated AS (
  SELECT *, CASE WHEN kind = 'message' THEN 'plain' WHEN kind = 'result' AND NOT has_call THEN 'orphan' WHEN kind = 'result' THEN 'linked'
                 WHEN level IS NULL THEN 'unresolved' WHEN NOT has_result THEN 'open' ELSE 'linked' END AS status,
            kind = 'result' AND has_call AS follows
  FROM joined
)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN follows THEN call_turn ELSE turn END, CASE WHEN kind = 'call' OR follows THEN coalesce(level, 0) ELSE -1 END,
         CASE WHEN follows THEN 1 ELSE place END, follows::INT, turn, place, json) - 1 AS position,
       turn, kind, id AS call_id, status, coalesce(level, -1) AS level,
       CASE WHEN valid THEN 'valid' WHEN NOT valid THEN 'invalid' ELSE 'none' END AS schema, json
FROM stated
"""


def tool_turns(turns: DataFrame) -> DataFrame:
    """The conversations as tool traffic: a user turn becomes a call, the turn after it the result, later calls take the first one's result."""
    own = F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn")
    words = F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit(""))) + 1
    context = F.when(F.col("turn") > 1, F.struct(F.concat(F.lit("c"), "conv_id", F.lit("-"), F.col("turn") % 2).alias("$result")))
    arguments = F.struct(F.col("text").alias("question"), words.alias("words"), context.alias("context"))
    call = F.struct(own.alias("id"), F.when(words <= 30, "ask").otherwise("search").alias("name"), arguments.alias("arguments"))
    result = F.struct(F.concat(F.lit("c"), "conv_id", F.lit("-"), F.col("turn") - 1).alias("tool_call_id"), F.col("text").alias("content"))
    is_user, is_answer = F.col("role") == "user", F.col("role") == "assistant"
    return turns.select(
        "conv_id", "turn", F.when(is_user, "assistant").when(is_answer, "tool").otherwise(F.col("role")).alias("role"),
        F.when(is_user, F.to_json(F.struct(F.array(call).alias("tool_calls")))).when(is_answer, F.to_json(result)).otherwise(F.col("text")).alias("text"),
    )


@query("op8_tool_links", CHAT_SQL)
def tool_links(spark: SparkSession, folder: str) -> DataFrame:
    return chats.link(tool_turns(table(spark, folder, "conversations")), SCHEMAS)


@query("op12_toxicity")
def text_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, folder, "labels")))


FINITE_SQL = "embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0"


def _means(assigned: str, cells: str, before: str, by: str) -> str:
    """Entries of the next round: exact floors of the means, unused entries as before."""
    return f"""SELECT {by}, b.c, b.i, coalesce(((s - ((s % n) + n) % n) // n)::BIGINT, b.x) AS x
  FROM {before} b LEFT JOIN (SELECT {by}, c, i, sum(x) AS s, count(*) AS n FROM {assigned} JOIN {cells} USING ({'r, p' if by == 'p' else 'r'}) GROUP BY {by}, c, i) m USING ({by}, c, i)"""


def codes_sql(rounds: int = codes.ROUNDS) -> str:
    """Rounds of assignment and means over (row, part, place) cells, written out one after the other."""
    steps = [f"""kept AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE {FINITE_SQL}
), cells AS (
  SELECT r, (k - 1) // (len(v) // 8) AS p, (k - 1) % (len(v) // 8) AS i, floor(4096 * v[k])::BIGINT AS x FROM (SELECT r, v, unnest(range(1, len(v) + 1)) AS k FROM kept)
), c0 AS (
  SELECT p, r - 1 AS c, i, x FROM cells WHERE r <= 16
)"""]
    for k in range(rounds + 1):
        steps.append(f"""a{k} AS (
  SELECT r, p, min(struct_pack(d := d, c := c)) AS m, struct_extract(m, 'c') AS c, struct_extract(m, 'd') AS d
  FROM (SELECT r, p, c, sum((v.x - b.x) * (v.x - b.x))::BIGINT AS d FROM cells v JOIN c{k} b USING (p, i) GROUP BY r, p, c) GROUP BY r, p
)""")
        if k < rounds:
            steps.append(f"c{k + 1} AS (\n  {_means(f'a{k}', 'cells', f'c{k}', 'p')}\n)")
    return "WITH " + ", ".join(steps) + f""", coded AS (
  SELECT r, string_agg(printf('%02x', c), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY r
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY p, c, i)) FROM c{rounds}) AS codebooks_sha256
FROM kept JOIN coded USING (r)
"""


@query("op11_ball_codes", codes_sql())
def vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    return codes.codes(table(spark, folder, "embeddings"))


def clusters_sql(rounds: int = centroids.ROUNDS) -> str:
    steps = [f"""kept AS (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) AS r, vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE {FINITE_SQL} AND len(embedding) = 64
), cells AS (
  SELECT r, i, floor(64 * v[i])::BIGINT AS x FROM (SELECT r, v, unnest(range(1, 65)) AS i FROM kept)
), c0 AS (
  SELECT 0 AS one, r - 1 AS c, i, x FROM cells WHERE r <= 16
)"""]
    for k in range(rounds + 1):
        steps.append(f"""a{k} AS (
  SELECT r, 0 AS one, min(struct_pack(d := d, c := c)) AS m, struct_extract(m, 'c') AS c, struct_extract(m, 'd') AS d
  FROM (SELECT r, c, sum((v.x - b.x) * (v.x - b.x))::BIGINT AS d FROM cells v JOIN c{k} b USING (i) GROUP BY r, c) GROUP BY r
)""")
        if k < rounds:
            steps.append(f"c{k + 1} AS (\n  {_means(f'a{k}', 'cells', f'c{k}', 'one')}\n)")
    return "WITH " + ", ".join(steps) + f"""
SELECT vec_id, a.c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256
FROM kept JOIN a{rounds} a USING (r) JOIN (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY c) USING (c)
"""


@query("op13_threshold_clusters", clusters_sql())
def vector_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return centroids.cluster(table(spark, folder, "embeddings"))
