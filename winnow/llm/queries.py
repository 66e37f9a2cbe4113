"""One registered query for each operator, with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.llm import (
    hardneg, langid, mixing, near_dedup, packing, pieces, pii, quality, spotsigs, topk, toxicity, urlfilter, whitening,
)
from winnow.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query("op3_near_dedup")
def op3(spark, sf_dir):
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


@query("op1_toxicity")
def op1(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


SCORES = """
WITH ok AS (
  SELECT vec_id, min(list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  GROUP BY vec_id
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(range(1, len(c.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM ok q JOIN ok c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM scored
)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM ranked WHERE n <= 10
"""


@query("op2_exact_topk", SCORES)
def op2(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 100 = 0"))


@query("op4_spotsigs")
def op4(spark, sf_dir):
    return spotsigs.compare_next(table(spark, sf_dir, "documents"))


VERDICTS = """
WITH parts AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/'
  END AS rule FROM parts
), listed AS (
  SELECT DISTINCT host AS bad FROM parts
  WHERE regexp_matches(host, '(^|[.-])(ads|adult|bets|casino|pills|spam|track)([.-]|$)')
)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('example.com/de/', 'net/') THEN 'block'
    WHEN rule IS NOT NULL THEN 'allow'
    WHEN EXISTS (SELECT 1 FROM listed WHERE host = bad OR ends_with(host, '.' || bad)) THEN 'block'
    ELSE 'allow' END AS verdict
FROM ruled
"""


@query("op5_url_cascade", VERDICTS)
def op5(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.judge(pages, urlfilter.hosts_with_words(pages))


@query("op6_langid")
def op6(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


@query("op9_quality_resampling")
def op9(spark, sf_dir):
    return quality.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op8_soft_mixing")
def op8(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return mixing.mix(docs, docs.select("doc_id", F.col("lang").alias("domain")))


@query("op7_pii")
def op7(spark, sf_dir):
    return pii.find(table(spark, sf_dir, "documents"))


@query("op10_sentencepiece")
def op10(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    back = pieces.decode(pieces.encode(docs))
    return back.select(
        "doc_id", F.size("ids").alias("n_tokens"), F.xxhash64("ids").alias("ids_hash"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )


@query("op11_whitening")
def op11(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


#: The vocabulary file of the packing query; every operator takes its path as a parameter.
BYTE_BPE = "byte_bpe_50k.json"


@query("op12_packing")
def op12(spark, sf_dir):
    import public_tokenizers

    pieces_ = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))
    return pieces_.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "source"
    )


MINED = """
WITH ok AS (
  SELECT vec_id AS id, min({
           'label': CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END,
           'v': list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS INTEGER))}) AS r
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  GROUP BY vec_id
), scored AS (
  SELECT a.id AS anchor_id, c.id, a.r.label = c.r.label AS same,
         CAST(coalesce(list_sum(list_transform(range(1, least(len(a.r.v), len(c.r.v)) + 1), lambda i: a.r.v[i] * c.r.v[i])), 0) AS BIGINT) AS score
  FROM ok a JOIN ok c ON a.id <> c.id WHERE a.id % 100 = 0
), positives AS (
  SELECT * FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
), ranked AS (
  SELECT p.anchor_id, p.id AS positive_id, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) AS place
  FROM positives p JOIN scored n ON p.anchor_id = n.anchor_id AND NOT n.same
   AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score
)
SELECT anchor_id, positive_id, CAST(place AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM ranked WHERE place <= 5
"""


@query("op13_hard_negatives", MINED)
def op13(spark, sf_dir):
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.mine(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label=shifted)
