"""Registered evaluation and result-shaping queries over the hybrid search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.context import citations, context_blocks
from quarry.operators.evaluate import macro_average, query_metrics, rank_and_flatten
from quarry.operators.fusion import hybrid_search
from quarry.plans.common import rounded
from quarry.plans.hybrid import LIMIT, RESULTS_CTES
from quarry.sources.tables import query_set, read_table, records


def _results(spark, sf):
    return hybrid_search(records(spark, sf), query_set(spark, sf), LIMIT, "max_norm",
                         with_records=True)


def _citations(spark, sf):
    return citations(_results(spark, sf))


def _flat(spark, sf):
    return rank_and_flatten(_citations(spark, sf))


def _judged(spark, sf) -> DataFrame:
    """Judgement 3 when the record's embedding label equals the query's and the
    result is in the top 3, 1 when equal further down, else 0."""
    emb = read_table(spark, sf, "embeddings").select("vec_id", "label")
    flat = _flat(spark, sf)
    ql = emb.select(F.col("vec_id").alias("query_id"), F.col("label").alias("qlabel"))
    dl = emb.select(F.col("vec_id").cast("string").alias("document_id"), F.col("label").alias("dlabel"))
    # label lookups: Spark picks the join strategy from the (checked) sizes;
    # the embeddings table is never broadcast on trust
    j = flat.join(ql, "query_id", "left").join(dl, "document_id", "left")
    same = F.col("qlabel") == F.col("dlabel")
    return j.withColumn("is_relevant", F.when(same & (F.col("rank") <= 3), 3)
                        .when(same, 1).otherwise(0))


def rank_results(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(spark, sf).select("query_id", "rank", "document_id", rounded("score"))


def eval_metrics(spark: SparkSession, sf: str) -> DataFrame:
    m = query_metrics(_judged(spark, sf), k=5)
    return m.select("query_id", "n_results", "n_relevant", rounded("precision"),
                    rounded("mrr"), rounded("ndcg"))


def macro_metrics(spark: SparkSession, sf: str) -> DataFrame:
    # every benchmark item is a question; those without a vector return nothing
    questions = read_table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"))
    m = macro_average(query_metrics(_judged(spark, sf), k=5), questions)
    return m.select("n_queries", rounded("mean_precision"), rounded("mean_mrr"),
                    rounded("mean_ndcg"))


def citation_groups(spark: SparkSession, sf: str) -> DataFrame:
    c = _citations(spark, sf)
    return c.select("query_id", "source_name", rounded("relevance"),
                    F.size("partitions").alias("n_partitions"))


def context_block_text(spark: SparkSession, sf: str) -> DataFrame:
    out = context_blocks(_citations(spark, sf), query_set(spark, sf))
    return out.select("query_id", F.sha2("context", 256).alias("context_sha256"),
                      F.length("context").alias("context_len"))


_JUDGED = f"""{RESULTS_CTES},
flat AS (SELECT query_id, rank, id AS document_id, score FROM results),
judged AS (
  SELECT f.*, CASE WHEN qe.label = de.label AND f.rank <= 3 THEN 3
                   WHEN qe.label = de.label THEN 1 ELSE 0 END AS is_relevant
  FROM flat f LEFT JOIN embeddings qe ON qe.vec_id = f.query_id
  LEFT JOIN embeddings de ON CAST(de.vec_id AS VARCHAR) = f.document_id),
ideal AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY is_relevant DESC NULLS LAST, rank) AS irank
          FROM judged),
metrics AS (
  SELECT query_id, count(*) AS n_results,
         CAST(sum(CASE WHEN is_relevant = 0 THEN 0 ELSE 1 END) AS BIGINT) AS n_relevant,
         sum(CASE WHEN is_relevant = 0 THEN 0 ELSE 1 END) / count(*) AS precision,
         coalesce(1.0 / min(CASE WHEN is_relevant = 3 THEN rank END), 0) AS mrr,
         CASE WHEN max(CASE WHEN is_relevant IS NULL THEN 1 ELSE 0 END) = 1 THEN 0.0
              WHEN sum(CASE WHEN irank <= 5 THEN coalesce(is_relevant, 0) / log2(irank + 1) ELSE 0 END) = 0 THEN 0.0
              ELSE sum(CASE WHEN rank <= 5 THEN coalesce(is_relevant, 0) / log2(rank + 1) ELSE 0 END)
                   / sum(CASE WHEN irank <= 5 THEN coalesce(is_relevant, 0) / log2(irank + 1) ELSE 0 END)
         END AS ndcg
  FROM ideal GROUP BY query_id)"""

_CLEAN = r"""array_to_string(list_filter(list_transform(
    regexp_split_to_array(array_to_string(list_transform(
        string_split(regexp_replace(coalesce({x}, ''), '\r\n|\r', chr(10), 'g'), chr(10)),
        lambda l: regexp_replace(l, '^\s+|\s+$', '', 'g')), chr(10)), '\n\n+'),
    lambda p: replace(regexp_replace(p, '^\n+|\n+$', '', 'g'), chr(10), ' ')), lambda p: p <> ''), chr(10))"""

_CONTEXT = f"""{RESULTS_CTES},
rec AS (SELECT r.query_id, r.id AS source_name, r.score, rr.content FROM results r JOIN records rr ON rr.id = r.id),
cit AS (SELECT query_id, source_name, score AS relevance,
               'Source: ' || source_name || chr(10)
               || CASE WHEN ({_CLEAN.format(x='content')}) <> ''
                       THEN '—— ' || ({_CLEAN.format(x='content')}) || chr(10) ELSE '' END
               || chr(10) AS block
        FROM rec),
blocks AS (SELECT query_id, string_agg(block, '' ORDER BY -relevance, source_name) AS b
           FROM cit GROUP BY query_id),
ctx AS (SELECT q.query_id, chr(10) || '[QUESTION]' || chr(10) || q.query_text || chr(10) || chr(10)
               || CASE WHEN b.b IS NULL THEN 'Aucun result trouvé.' || chr(10)
                       ELSE '[SEARCH RESULTS]' || chr(10) || b.b END AS context
        FROM query_set q LEFT JOIN blocks b USING (query_id)
        WHERE q.query_text IS NOT NULL AND trim(q.query_text) <> '')"""

SQL = {
    "rank_results": f"""{_JUDGED}
SELECT query_id, rank, document_id, round(score, 6) + 0.0 AS score FROM flat""",
    "eval_metrics": f"""{_JUDGED}
SELECT query_id, n_results, n_relevant, round(precision, 6) + 0.0 AS precision,
       round(mrr, 6) + 0.0 AS mrr, round(ndcg, 6) + 0.0 AS ndcg FROM metrics""",
    "macro_metrics": f"""{_JUDGED}
SELECT count(*) AS n_queries, round(sum(precision) / count(*), 6) + 0.0 AS mean_precision,
       round(sum(mrr) / count(*), 6) + 0.0 AS mean_mrr, round(sum(ndcg) / count(*), 6) + 0.0 AS mean_ndcg
FROM benchmark b LEFT JOIN metrics m ON m.query_id = b.item_id""",
    "citation_groups": f"""{RESULTS_CTES}
SELECT query_id, id AS source_name, round(score, 6) + 0.0 AS relevance, CAST(1 AS BIGINT) AS n_partitions FROM results""",
    "context_block_text": f"""{_CONTEXT}
SELECT query_id, sha256(context) AS context_sha256, length(context) AS context_len FROM ctx""",
}

QUERIES = {
    "rank_results": rank_results,
    "eval_metrics": eval_metrics,
    "macro_metrics": macro_metrics,
    "citation_groups": citation_groups,
    "context_block_text": context_block_text,
}
