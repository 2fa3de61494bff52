"""Ranking evaluation: flatten, rank, judge, per-query metrics, macro average.

All metrics are aggregates per ``query_id`` (one hash aggregation with
map-side partial combine) plus one window for the ideal order; a query's
window holds only its returned results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LABELS = (0, 1, 3)  # judgement scale: not relevant, relevant, highly relevant


def rank_and_flatten(citations: DataFrame) -> DataFrame:
    """``(query_id, source_name, partitions array<struct<text, relevance, ...>>)``
    -> ``(query_id, rank, document_id, extracted_text, score)``, ranked by
    relevance (descending) over all partitions of all citations of a query."""
    flat = citations.select("query_id", F.col("source_name").alias("document_id"),
                            F.explode("partitions").alias("p"))
    w = Window.partitionBy("query_id").orderBy(F.col("p.relevance").desc(),
                                               F.col("document_id"), F.col("p.text"))
    return flat.select("query_id", F.row_number().over(w).alias("rank"), "document_id",
                       F.col("p.text").alias("extracted_text"),
                       F.col("p.relevance").alias("score"))


def validate_labels(judgements: DataFrame, col: str = "is_relevant") -> DataFrame:
    """Rows whose label is neither NULL nor on the 0/1/3 scale."""
    return judgements.where(F.col(col).isNotNull() & ~F.col(col).isin(*LABELS))


def attach_judgements(results: DataFrame, labels: DataFrame,
                      on=("query_id", "rank")) -> DataFrame:
    """Left join of the returned documents with a labels table; unlabelled
    results keep ``is_relevant = NULL`` (unjudged)."""
    return results.join(labels.select(*on, "is_relevant"), list(on), "left")


def query_metrics(judged: DataFrame, k: int = 5, unjudged: str = "relevant") -> DataFrame:
    """``(query_id, n_results, n_relevant, precision, mrr, ndcg)`` per query.

    * precision: share of results with a label other than 0; an unjudged
      (NULL) label counts as relevant unless ``unjudged='irrelevant'``;
    * mrr: 1 / rank of the first result labelled 3, else 0;
    * ndcg@k: linear gain, ``rel / log2(rank + 1)``, ideal order from the
      returned results; 0 when any label is NULL or the ideal DCG is 0;
      positions beyond the returned list count 0.
    """
    rel = F.col("is_relevant")
    relevant = (F.when(rel == 0, 0).otherwise(1) if unjudged == "relevant"
                else F.when(rel.isNull() | (rel == 0), 0).otherwise(1))
    ideal = Window.partitionBy("query_id").orderBy(rel.desc_nulls_last(), F.col("rank"))
    g = judged.withColumn("irank", F.row_number().over(ideal))

    def gain(pos):
        return F.when(pos <= k, F.coalesce(rel, F.lit(0)) / F.log2(pos + F.lit(1.0))).otherwise(0.0)

    agg = g.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n_results"),
        F.sum(relevant).alias("n_relevant"),
        F.min(F.when(rel == 3, F.col("rank"))).alias("first3"),
        F.sum(gain(F.col("rank"))).alias("dcg"),
        F.sum(gain(F.col("irank"))).alias("idcg"),
        F.max(F.when(rel.isNull(), 1).otherwise(0)).alias("has_null"))
    return agg.select(
        "query_id", "n_results", "n_relevant",
        (F.col("n_relevant") / F.col("n_results")).alias("precision"),
        F.coalesce(F.lit(1.0) / F.col("first3"), F.lit(0.0)).alias("mrr"),
        F.when((F.col("has_null") == 1) | (F.col("idcg") == 0), F.lit(0.0))
         .otherwise(F.col("dcg") / F.col("idcg")).alias("ndcg"))


def macro_average(metrics: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """One row: mean precision, MRR and nDCG over the queries.

    With ``queries (query_id)`` the mean is over all of them: a query without any
    result counts with precision, MRR and nDCG 0."""
    if queries is not None:
        metrics = queries.select("query_id").distinct().join(metrics, "query_id", "left").fillna(
            0.0, ["precision", "mrr", "ndcg"])
    return metrics.agg(F.count(F.lit(1)).alias("n_queries"),
                       F.avg("precision").alias("mean_precision"),
                       F.avg("mrr").alias("mean_mrr"),
                       F.avg("ndcg").alias("mean_ndcg"))
