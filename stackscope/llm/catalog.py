"""The registered queries of these operators, and SQL where it gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackscope.llm import (decontaminate, html, lines, minhash, negatives, packing, quality, secrets, spelling, topk,
                            toxicity, urls, vectorgraph)
from stackscope.llm.common import table


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, percent=80)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), k=5, every=50)


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def vocabulary() -> str:
    """Path of the byte-level vocabulary, which the tokenizer files' own package knows."""
    import public_tokenizers
    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary())


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    chain = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    spans = F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string")))
    return toxicity.score(docs, chain).withColumn("spans", F.array_join(spans, ","))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.transform("removed", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string")))
    # lines of one to five words, such as "Le." or "In.", repeat by chance
    return lines.dedup(table(spark, sf_dir, "documents"), min_line_words=6).withColumn("removed", F.array_join(spans, ","))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


def op10_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_vector_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorgraph.near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.9)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine(table(spark, sf_dir, "embeddings"), every=100, positives=5, negatives=10)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_near_duplicates, op2_url_filter, op3_exact_top_k, op4_main_text, op5_packing, op6_toxicity, op7_line_dedup,
    op8_secret_scan, op9_decontamination, op10_quality_resampling, op11_vector_graph, op12_hard_negatives,
    op13_spelling_variants)}

SQL: dict[str, str] = {}

SQL["op3_exact_top_k"] = """
WITH p AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT score
  FROM p q JOIN p c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) rank FROM s)
SELECT query_id, rank::INTEGER rank, vec_id, score FROM r WHERE rank <= 5"""


SQL["op11_vector_graph"] = """
WITH RECURSIVE p AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (
  SELECT a.vec_id a, b.vec_id b FROM p a JOIN p b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_inner_product(a.v, b.v) >= 0.9 * sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))),
reach AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a)
SELECT e.vec_id, coalesce(n.c, 0)::BIGINT n_links, least(e.vec_id, coalesce(m.low, e.vec_id)) component_id,
       e.vec_id <= coalesce(m.low, e.vec_id) kept
FROM embeddings e LEFT JOIN (SELECT a, count(*) c FROM l GROUP BY a) n ON n.a = e.vec_id
LEFT JOIN (SELECT a, min(b) low FROM reach GROUP BY a) m ON m.a = e.vec_id"""

SQL["op12_hard_negatives"] = """
WITH p AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id anchor_id, c.vec_id, q.label = c.label AS same, list_inner_product(q.v, c.v)::BIGINT score
  FROM p q JOIN p c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)),
pos AS (
  SELECT anchor_id, vec_id positive_id, score positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
neg AS (
  SELECT anchor_id, positive_id, vec_id negative_id, positive_score, score negative_score,
         row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) rank
  FROM pos JOIN s USING (anchor_id)
  WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank::INTEGER rank, negative_id, positive_score, negative_score FROM neg WHERE rank <= 10"""
