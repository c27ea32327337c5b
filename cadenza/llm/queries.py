"""The queries of the training-data operators, over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm import bpe, chat, htmlwrap, linededup, mixing, negatives, pii, quality, simhash, tokenalign, tokenfile, topk, urlfilter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select(
        "doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"), F.col("mix_taken").alias("taken"))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.near_duplicates(table(spark, sf_dir, "documents")))


#: A dated list: entry, day, action.
URL_LIST = [
    ("spam-farm.example.org", "2024-01-15", "add"),
    ("cheap-pills.example.com", "2023-06-01", "add"),
    ("cheap-pills.example.com", "2024-05-01", "remove"),
    ("cheap-pills.example.com", "2024-09-01", "add"),
    ("*.free-bets.example.com", "2024-03-10", "add"),
    ("http://tionsh.example.net/en/", "2024-02-01", "add"),
    ("tionsh.example.net/en", "2024-08-01", "remove"),
    ("blog.tionble.example.com/fr", "2024-04-04", "add"),
    ("example.org", "2024-11-30", "add"),
    ("example.org", "2024-12-03", "remove"),
]


def op4_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages have no time of fetching: their ids stand for the days of 2024, in turn."""
    entries = spark.createDataFrame(URL_LIST, "entry string, dated string, action string")
    day = F.expr("date_add(DATE'2024-01-01', CAST(pmod(page_id, 366) AS INT))")
    out = urlfilter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url", day.alias("fetched")), entries)
    return out.select("page_id", "url", F.col("fetched").cast("string").alias("fetched"), "url_blocked", F.array_join("url_rules", " ").alias("rules"))


def op5_tokenfile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.tokenize(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), special=True)


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    return chat.digest(chat.format_conversations(rows.unionByName(more)))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op8_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_dropped_lines")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode_decode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmlwrap.main_text(table(spark, sf_dir, "pages"))


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op12_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return tokenalign.align(table(spark, sf_dir, "documents"), a, b)


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where vec_id is divisible by 7 the label is the next one of ten."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("id") % 50 == 0)


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':1'), 1, 15))::BIGINT AS key
  FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT + 1]::DOUBLE AS weight,
              (3 * source_size)::DOUBLE AS cap FROM s0),
s2 AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE
                   - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                  / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
       FROM s1 WINDOW o AS (ORDER BY cap / weight, source NULLS LAST)),
s3 AS (SELECT *, least(cap, weight * (SELECT max(level) FROM s2 WHERE level * weight <= cap)) AS target FROM s2),
s AS (SELECT *, CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END AS epochs FROM s3),
k AS (SELECT source, key, sum(size)::BIGINT AS key_size,
             (sum(sum(size)) OVER (PARTITION BY source ORDER BY key))::BIGINT AS upto FROM d GROUP BY source, key)
SELECT d.doc_id, d.size, s.source_size, s.target,
       (s.epochs * d.size + CASE WHEN key_size = 0 THEN 0 ELSE d.size * greatest(0, least(key_size,
           round(s.target)::BIGINT - s.epochs * s.source_size - (upto - key_size))) // key_size END)::BIGINT AS taken
FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source
       JOIN k ON d.source IS NOT DISTINCT FROM k.source AND d.key = k.key
"""


OP2_SQL = r"""
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, max(list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

_ENTRIES = ", ".join(f"('{e}', DATE '{d}', '{a}')" for e, d, a in URL_LIST)
OP4_SQL = rf"""
WITH listed AS (
  SELECT regexp_replace(regexp_replace(e, '^[a-z]+://', ''), '^\*\.|/+$', '', 'g') AS key, d AS day, a = 'add' AS is_on
  FROM (VALUES {_ENTRIES}) t(e, d, a)),
spans AS (SELECT key, day AS since, is_on, lead(day) OVER (PARTITION BY key ORDER BY day) AS until FROM listed),
p AS (SELECT page_id, url, (DATE '2024-01-01' + (page_id % 366)::INT) AS fetched,
             lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:@]*)', 1)) AS host,
             regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)?', 1), '/+$', '') AS path FROM pages),
hit AS (
  SELECT p.page_id, p.url, s.key FROM p JOIN spans s
    ON s.is_on AND s.since <= p.fetched AND (s.until IS NULL OR p.fetched < s.until)
   AND ('.' || p.host) LIKE ('%.' || split_part(s.key, '/', 1))
   AND (p.path || '/') LIKE (substr(s.key, length(split_part(s.key, '/', 1)) + 1) || '/%'))
SELECT p.page_id, p.url, p.fetched::VARCHAR AS fetched, count(hit.key) > 0 AS url_blocked,
       coalesce(string_agg(hit.key, ' ' ORDER BY hit.key), '') AS rules
FROM p LEFT JOIN hit ON p.page_id = hit.page_id GROUP BY p.page_id, p.url, p.fetched
"""

OP6_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
f AS (SELECT *, regexp_replace(text, '(\[/?|</?)(\\*)(INST\]|s>)', '\1\\\2\3', 'g') AS safe FROM c),
g AS (
  SELECT conv_id, count(*)::BIGINT AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
         coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS loss,
         sum(CASE WHEN role = 'assistant' THEN 7 ELSE 14 + length(role) END + length(safe))::BIGINT AS formatted_chars
  FROM f GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256,
       formatted_chars, true AS round_trip FROM g
"""

OP13_SQL = r"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id,
       (row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id))::INT AS rank,
       n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
QUALIFY rank <= 3
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_mixing, op2_topk, op3_simhash, op4_urlfilter, op5_tokenfile, op6_chat, op7_quality, op8_linededup, op9_bpe, op10_html, op11_pii, op12_align, op13_negatives]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": OP1_SQL, "op2_topk": OP2_SQL, "op4_urlfilter": OP4_SQL, "op6_chat": OP6_SQL, "op13_negatives": OP13_SQL}
