"""Hybrid retrieval: fuse vector and full-text candidates per query.

Each side keeps its ``candidate_factor * limit`` best rows per query, the two
candidate sets meet in a full outer join on ``(query_id, id)`` and the fused
score is computed with per-query windows - every window partition holds at
most ``2 * candidate_factor * limit`` rows, whatever the table size.

Modes
-----
``rrf``       ``1/(k_vec + rank_vec) + 1/(k_text + rank_text)``; ranks are taken
              over the fused rows.  ``missing='postgres'`` (default) reproduces
              PostgreSQL null ordering - a row without a vector score ranks
              after all others on the vector side, a row without a text score
              ranks *before* all others on the text side; ``missing='classic'``
              ranks each side among its own rows and lets an absent side add 0.
``max_norm``  ``vec/max(vec) + text/max(text)`` over the candidates, missing or
              zero-maximum terms count 0; vector score is the similarity, text
              score the length-normalised cover density.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.tags import tags_filter
from quarry.operators.text_search import text_search
from quarry.operators.vector_search import MAX_BROADCAST_HITS, candidates_and_count

K_VEC = 60
K_TEXT = 30
CANDIDATE_FACTOR = 3


def fuse(vec: DataFrame, txt: DataFrame, limit: int, mode: str = "rrf", *,
         k_vec: int = K_VEC, k_text: int = K_TEXT, missing: str = "postgres") -> DataFrame:
    """Fuse ``vec (query_id, id, vec_score)`` and ``txt (query_id, id, text_score)``.

    For ``rrf`` a lower ``vec_score`` (a distance) is better; for ``max_norm``
    a higher one (a similarity)."""
    if limit < 0:
        raise ValueError("limit must be >= 0")
    if mode not in ("rrf", "max_norm"):
        raise ValueError(f"unknown fusion mode {mode!r}")
    if missing not in ("postgres", "classic"):
        raise ValueError(f"unknown missing-side rule {missing!r}")
    both = vec.join(txt, ["query_id", "id"], "full_outer")
    by_q = Window.partitionBy("query_id")
    v, t = F.col("vec_score"), F.col("text_score")
    if mode == "rrf":
        rv = F.row_number().over(by_q.orderBy(v.asc_nulls_last(), F.col("id")))
        if missing == "postgres":
            rt = F.row_number().over(by_q.orderBy(t.desc_nulls_first(), F.col("id")))
            score = F.lit(1.0) / (F.lit(k_vec) + rv) + F.lit(1.0) / (F.lit(k_text) + rt)
        else:
            rt = F.row_number().over(by_q.orderBy(t.desc_nulls_last(), F.col("id")))
            score = (F.when(v.isNotNull(), F.lit(1.0) / (F.lit(k_vec) + rv)).otherwise(0.0)
                     + F.when(t.isNotNull(), F.lit(1.0) / (F.lit(k_text) + rt)).otherwise(0.0))
    else:
        mv = F.max(v).over(by_q)
        mt = F.max(t).over(by_q)
        score = (F.coalesce(v / F.nullif(mv, F.lit(0.0)), F.lit(0.0))
                 + F.coalesce(t / F.nullif(mt, F.lit(0.0)), F.lit(0.0)))
    scored = both.withColumn("score", score)
    ranked = scored.withColumn(
        "rank", F.row_number().over(by_q.orderBy(F.col("score").desc(), F.col("id"))))
    return ranked.where(F.col("rank") <= limit).select(
        "query_id", "id", "vec_score", "text_score", "score", "rank")


def hybrid_candidates(records: DataFrame, queries: DataFrame, limit: int, mode: str,
                      candidate_factor: int = CANDIDATE_FACTOR, filters=None,
                      index: DataFrame | None = None):
    n_cand = candidate_factor * limit
    if n_cand <= 0:  # nothing is asked for, so nothing is searched
        empty = queries.select("query_id", F.lit(None).cast("string").alias("id"))
        return (empty.withColumn("vec_score", F.lit(None).cast("double")).limit(0),
                empty.withColumn("text_score", F.lit(None).cast("double")).limit(0), 0)
    vc, n_queries = candidates_and_count(records, queries, n_cand, filters=filters)
    vec_score = F.col("distance") if mode == "rrf" else (F.lit(1.0) - F.col("distance"))
    vec = vc.select("query_id", "id", vec_score.alias("vec_score"))
    recs_for_text = records.where(tags_filter(filters)) if filters else records
    tc = text_search(recs_for_text, queries, n_cand, length_norm=(mode == "max_norm"), index=index,
                     only=recs_for_text.select("id") if filters else None)
    txt = tc.select("query_id", "id", "text_score")
    return vec, txt, n_queries


def hybrid_search(records: DataFrame, queries: DataFrame, limit: int = 10, mode: str = "rrf", *,
                  k_vec: int = K_VEC, k_text: int = K_TEXT, missing: str = "postgres",
                  candidate_factor: int = CANDIDATE_FACTOR, filters=None,
                  with_records: bool = False, with_embeddings: bool = False,
                  index: DataFrame | None = None) -> DataFrame:
    """Top ``limit`` fused records per query.

    ``queries`` has ``(query_id, query_text, query_vec)``. ``filters`` is an
    optional tag pre-filter applied to both sides (the public search entry of
    the original accepts and ignores it, which is the default here)."""
    if limit < 0:
        raise ValueError("limit must be >= 0")
    vec, txt, n_queries = hybrid_candidates(records, queries, limit, mode, candidate_factor, filters,
                                            index)
    out = fuse(vec, txt, limit, mode, k_vec=k_vec, k_text=k_text, missing=missing)
    if with_records:
        cols = ["id", "tags", "content", "payload"] + (["embedding"] if with_embeddings else [])
        hits = F.broadcast(out) if n_queries * limit <= MAX_BROADCAST_HITS else out
        out = records.select(*cols).join(hits, "id")
    return out


def search(records: DataFrame, queries: DataFrame, limit: int = 10, *,
           use_normalization: bool = False, filters=None, min_relevance: float | None = None,
           apply_filters: bool = False, with_embeddings: bool = False,
           index: DataFrame | None = None) -> DataFrame:
    """Public search entry: always the hybrid search, RRF (default) or
    max-normalised.  ``filters`` and ``min_relevance`` are accepted and, as in
    the original entry point, ignored unless ``apply_filters=True``."""
    out = hybrid_search(records, queries, limit, "max_norm" if use_normalization else "rrf",
                        filters=filters if apply_filters else None, with_records=True,
                        with_embeddings=with_embeddings, index=index)
    if apply_filters and min_relevance is not None:
        out = out.where(F.col("score") >= F.lit(min_relevance))
    return out
