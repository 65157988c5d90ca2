"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, language, lm, mix, ngram_join, packing, quality, secrets, topk, url_filter
from .common import table


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "n_copies", "n_links")


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mix.plan_mix(table(spark, sf_dir, "documents"))
    return planned.select("doc_id", "size", "source_size", "target", "taken")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.quality_rules(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.link(table(spark, sf_dir, "conversations"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    found = secrets.scan(docs, keep=["doc_id"])
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
        F.sha2(secrets.joined(F.col("base")), 256).alias("base_sha256"), secrets.joined(F.col("marked")).alias("spans"),
        F.size(F.filter("marked", lambda s: s["live"])).cast("long").alias("n_live"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_ngram_join": op1_ngram_join, "op2_mix": op2_mix, "op3_language": op3_language, "op4_packing": op4_packing, "op5_topk": op5_topk, "op6_lm_score": op6_lm_score, "op7_quality": op7_quality, "op8_url_filter": op8_url_filter, "op9_chat": op9_chat, "op10_secrets": op10_secrets}


def oracle_sql() -> dict[str, str]:
    return {"op5_topk": OP5_SQL, "op8_url_filter": OP8_SQL}


OP5_SQL = r"""
WITH flat AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
sound AS (SELECT vec_id FROM flat GROUP BY vec_id HAVING count(x) = count(*) AND bool_and(isfinite(x))),
ints AS (SELECT vec_id, i, floor(64 * x)::BIGINT AS v FROM flat WHERE vec_id IN (SELECT vec_id FROM sound)),
scores AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, sum(q.v * c.v)::BIGINT AS score FROM ints q JOIN ints c ON q.i = c.i AND q.vec_id <> c.vec_id
  WHERE q.vec_id % 20 = 0 GROUP BY q.vec_id, c.vec_id),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r, vec_id, score FROM scores)
SELECT query_id, r::INTEGER AS rank, vec_id, score FROM ranked WHERE r <= 20
"""


OP8_SQL = r"""
WITH rules(rhost, rpath, rverdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
fits AS (SELECT page_id, host, path, rhost || rpath AS rule, rverdict FROM parts JOIN rules
  ON (host = rhost OR host LIKE '%.' || rhost) AND starts_with(path, rpath)),
best AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(rverdict, length(rule)) AS verdict FROM fits GROUP BY page_id)
SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.verdict, 'allow') AS verdict FROM parts p LEFT JOIN best b USING (page_id)
"""
