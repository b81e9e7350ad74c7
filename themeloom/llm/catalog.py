"""Registered queries over these operators, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom.llm import (align, bpe, linetree, mixing, packing, quality, sanitise, secret_links, simhash, topk, toxicity,
                           urlfilter, variants)
from themeloom.llm.common import table

TOKENIZER = "word_bpe_49k.json"
ALIGNED = ("byte_bpe_50k.json", "piece_bpe_32k.model")
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"),
         ("net/fr/", "block"))
# Sites whose pages make up the list of URLs; a page with such a URL in any form is listed.
LISTED_SITES = r"(^|\.)(spam-farm|cheap-pills)\."

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    REGISTRY[f.__name__] = f
    return f


@query
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(table(spark, sf_dir, "documents"))


@query
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linetree.report(table(spark, sf_dir, "documents"))


@query
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sanitise.report(table(spark, sf_dir, "documents"))


@query
def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def listed_urls(pages: DataFrame) -> DataFrame:
    host, _ = urlfilter.host_and_path(F.col("url"))
    return pages.where(host.rlike(LISTED_SITES)).select("url")


@query
def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.judge(pages, listed_urls(pages), RULES)


@query
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER)).drop("ids")


@query
def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


@query
def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_links.report(table(spark, sf_dir, "documents"))


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@query
def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.groups(table(spark, sf_dir, "documents"))


@query
def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, second = map(public_tokenizers.path, ALIGNED)
    return align.align(table(spark, sf_dir, "documents"), first, second, digest=True)


@query
def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(table(spark, sf_dir, "documents"))


ORACLES: dict[str, str] = {}

# Times of the curves early, late and in the middle: roots of the integrals of straight lines.
ORACLES["op13_mixing"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS place FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
             row_number() OVER (ORDER BY source NULLS LAST) AS nth FROM d GROUP BY source),
w AS (SELECT *, CASE nth % 3 WHEN 1 THEN 3 WHEN 2 THEN 1 ELSE 2 END AS weight, 2 * source_size AS cap FROM s),
o AS (SELECT *, cap / weight AS ratio, sum(cap) OVER (ORDER BY cap / weight, nth) AS caps,
             sum(weight) OVER (ORDER BY cap / weight, nth) AS weights FROM w),
l AS (SELECT *, ((SELECT 1.5 * sum(source_size) FROM s)::DOUBLE - (caps - cap))
             / ((SELECT sum(weight) FROM w) - (weights - weight)) AS level FROM o),
f AS (SELECT min(ratio) AS ratio, arg_min(level, (ratio, nth)) AS level FROM l WHERE ratio > level),
t AS (SELECT l.*, CASE WHEN f.level IS NOT NULL AND l.ratio >= f.ratio THEN f.level * weight ELSE CAST(cap AS DOUBLE) END AS target
      FROM l, f),
r AS (SELECT d.*, source_size, target, (nth - 1) % 3 AS curve,
             sum(size) OVER (PARTITION BY nth ORDER BY place NULLS FIRST, doc_id NULLS FIRST, size, row) - size AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, e * source_size + before AS start, CAST(e * source_size + before AS DOUBLE) / target AS done,
             greatest(least(CAST(floor(target + 0.5) AS BIGINT) - (e * source_size + before), size), 0) AS take
      FROM r, (VALUES (0), (1)) AS v(e)),
m AS (SELECT *, round(CASE curve
        WHEN 0 THEN least(2 * done / (1.5 + sqrt(greatest(2.25 - 2.0 * done, 0))), 1)
        WHEN 1 THEN least(2 * done / (0.5 + sqrt(greatest(0.25 + 2.0 * done, 0))), 1)
        ELSE CASE WHEN done >= 0.5 THEN least(0.5 + 2 * (done - 0.5) / (1.5 + sqrt(greatest(2.25 - 4.0 * (done - 0.5), 0))), 1)
             ELSE least(2 * done / (0.5 + sqrt(greatest(0.25 + 4.0 * done, 0))), 0.5) END END, 9) AS time
      FROM c WHERE take > 0),
b AS (SELECT *, sum(take) OVER (ORDER BY time, place NULLS FIRST, doc_id NULLS FIRST, size, e, row) - take AS begin FROM m),
g AS (SELECT row, sum(take) AS taken, min(time) AS time, min(begin) AS begin FROM b GROUP BY row)
SELECT r.doc_id, CAST(r.size AS BIGINT) AS size, r.source_size, r.target, CAST(coalesce(g.taken, 0) AS BIGINT) AS taken,
       g.time, CAST(g.begin AS BIGINT) AS begin FROM r LEFT JOIN g USING (row)
"""

ORACLES["op8_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""

ORACLES["op6_url_filter"] = r"""
WITH p AS (
  SELECT page_id, coalesce(url, '') AS url,
    CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (
  SELECT page_id, url,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
    regexp_replace(regexp_replace(regexp_extract(url, '^[^?#]*\?([^#]*)', 1),
      '(^|&)(utm_[a-z]+|ref)=[^&]*', '', 'g'), '^&+', '') AS query FROM p),
c AS (
  SELECT *, regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '')
    || CASE WHEN query = '' THEN '' ELSE '?' || query END AS canonical FROM h),
l AS (SELECT DISTINCT canonical FROM c WHERE regexp_matches(host, '(^|\.)(spam-farm|cheap-pills)\.')),
r AS (
  SELECT c.*, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/' END AS rule FROM c)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN host <> '' AND canonical IN (SELECT canonical FROM l) THEN 'block' ELSE 'allow' END AS verdict FROM r
"""
