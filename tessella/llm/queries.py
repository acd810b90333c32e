"""The registered queries of this subpackage and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import edits, langid, lmscore, packing, pii, sampling, simhash, tokencount, topk, urls
from tessella.llm.common import columns, cut, id_remainder, table

RULES = (urls.Rule("org", "/", "allow"), urls.Rule("example.org", "/es/", "block"), urls.Rule("example.org", "/en/1", "block"), urls.Rule("com", "/fr/", "allow"), urls.Rule("com", "/de/", "block"))
#: Host labels whose pages make up the list that op1 looks URLs up in (fixed values).
LISTED_LABELS = ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = columns(table(spark, sf_dir, "pages"), "page_id", "url")
    marked = pages.where(urls.url_host(F.col("url")).rlike(rf"(^|\.)({'|'.join(LISTED_LABELS)})\."))
    # as another crawl may have written them: no form equals the page's own, only the canonical forms agree
    known = urls.canonical_url(F.col("url"))
    listed = marked.select(F.concat(F.lit("HTTP://WWW."), F.regexp_extract(known, "^[^/?]*", 0), F.lit(":80"), F.regexp_replace(known, "^[^/?]*", ""), F.lit("#listed")).alias("url"))
    return urls.filter_urls(pages, listed, RULES)


OP1_SQL = r"""
WITH p AS (SELECT page_id, url, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
c AS (SELECT *, CASE WHEN contains(url, '://') THEN regexp_replace(regexp_replace(host, '^www\.', ''), ':(80|443)$', '') || regexp_replace(path, '/+$', '') ||
  CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END END AS canonical
  FROM (SELECT *, list_sort(list_filter(string_split(regexp_extract(url, '(?s)^.*?://[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid)(=|$)'))) AS q FROM p)),
l AS (SELECT DISTINCT canonical FROM c WHERE regexp_matches(host, '(^|\.)(adult-x|ads-track|casino-win|cheap-pills|free-bets|spam-farm)\.') AND canonical IS NOT NULL),
r AS (SELECT page_id, host, path, l.canonical IS NOT NULL AS listed,
  CASE WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
       WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
       WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
       WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
       WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM c LEFT JOIN l ON c.canonical = l.canonical)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN listed THEN 'block' ELSE 'allow' END AS verdict, listed FROM r
"""


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    # whether the Bloom filter let a URL through has no SQL equivalent; the operator returns it, the query does not
    return op1_url_filter(spark, sf_dir).drop("possible")


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(columns(table(spark, sf_dir, "documents"), "doc_id", "text"))
    return found.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(columns(table(spark, sf_dir, "documents"), "doc_id", "text"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(columns(table(spark, sf_dir, "documents"), "doc_id", "text"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = columns(table(spark, sf_dir, "documents"), "doc_id", "text", "lang").withColumn("held_out", id_remainder(F.col("doc_id"), 3) == 1)
    model = langid.train(docs.where("not held_out"))
    return langid.identify(docs.drop("lang"), model).drop("text")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(columns(table(spark, sf_dir, "documents"), "doc_id", "text"))


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = columns(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return topk.top_k(vectors, F.pmod("vec_id", F.lit(50)) == 0)


OP4_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q, v c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op5_edit_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cut(edits.neighbours(columns(table(spark, sf_dir, "documents"), "doc_id", "text")), "edits-neighbours")
    return edits.near_duplicates(found)


def op9_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.sampled_pieces(columns(table(spark, sf_dir, "documents"), "doc_id", "text"))


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = columns(table(spark, sf_dir, "documents"), "doc_id", "text")
    held_out = id_remainder(F.col("doc_id"), 5) == 1
    return lmscore.score_texts(docs.withColumn("learn", ~held_out)).withColumn("held_out", held_out)


QUERIES = {
    "op1_url_filter": op1,
    "op2_token_counts": op2_token_counts,
    "op3_simhash_near_dedup": op3_simhash_near_dedup,
    "op4_exact_topk": op4_exact_topk,
    "op5_edit_fingerprints": op5_edit_fingerprints,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_personal_data": op7_personal_data,
    "op8_language_id": op8_language_id,
    "op9_sampled_pieces": op9_sampled_pieces,
    "op10_lm_scores": op10_lm_scores,
}

SQL = {"op1_url_filter": OP1_SQL, "op4_exact_topk": OP4_SQL}
