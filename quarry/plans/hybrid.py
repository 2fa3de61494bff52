"""Registered hybrid searches (RRF with both null rules, max-normalised)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.operators.fusion import hybrid_search
from quarry.plans.common import SCORED_CTE, rounded
from quarry.plans.text import TEXT_CTES
from quarry.sources.tables import query_set, records

LIMIT = 5


def _out(df: DataFrame) -> DataFrame:
    return df.select("query_id", "id", rounded("vec_score"), rounded("text_score"),
                     rounded("score"), "rank")


def hybrid_rrf_postgres(spark: SparkSession, sf: str) -> DataFrame:
    return _out(hybrid_search(records(spark, sf), query_set(spark, sf), LIMIT, "rrf"))


def hybrid_rrf_classic(spark: SparkSession, sf: str) -> DataFrame:
    return _out(hybrid_search(records(spark, sf), query_set(spark, sf), LIMIT, "rrf",
                              missing="classic"))


def hybrid_max_norm(spark: SparkSession, sf: str) -> DataFrame:
    return _out(hybrid_search(records(spark, sf), query_set(spark, sf), LIMIT, "max_norm"))


def _cands(vec_expr: str, text_source: str) -> str:
    return f"""WITH {TEXT_CTES}, {SCORED_CTE.format(where='')},
normed AS (SELECT c.query_id, c.id, c.score / ln(1 + d.n_pos) AS score
           FROM covers c JOIN doclen d USING (id)),
vc AS (SELECT query_id, id, {vec_expr} AS vec_score FROM (
         SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS r FROM scored)
       WHERE r <= {3 * LIMIT}),
tc AS (SELECT query_id, id, score AS text_score FROM (
         SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r
         FROM {text_source}) WHERE r <= {3 * LIMIT}),
fused AS (SELECT coalesce(vc.query_id, tc.query_id) AS query_id, coalesce(vc.id, tc.id) AS id,
                 vc.vec_score, tc.text_score
          FROM vc FULL OUTER JOIN tc ON vc.query_id = tc.query_id AND vc.id = tc.id)"""


def _final(score_sql: str) -> str:
    return f""",
s AS (SELECT *, {score_sql} AS score FROM fused),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s)
SELECT query_id, id, round(vec_score, 6) + 0.0 AS vec_score, round(text_score, 6) + 0.0 AS text_score,
       round(score, 6) + 0.0 AS score, rank FROM r WHERE rank <= {LIMIT}"""


MAX_NORM_SQL = ("coalesce(vec_score / nullif(max(vec_score) OVER (PARTITION BY query_id), 0), 0) + "
                "coalesce(text_score / nullif(max(text_score) OVER (PARTITION BY query_id), 0), 0)")

# hybrid max-norm top 5 as a CTE named ``results (query_id, id, score, rank)``
RESULTS_CTES = _cands("1 - distance", "normed") + f""",
s AS (SELECT *, {MAX_NORM_SQL} AS score FROM fused),
results AS (SELECT query_id, id, score,
                   row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank
            FROM s QUALIFY rank <= {LIMIT})"""

_RV = "row_number() OVER (PARTITION BY query_id ORDER BY vec_score ASC NULLS LAST, id)"

SQL = {
    "hybrid_rrf_postgres": _cands("distance", "covers") + _final(
        f"1.0 / (60 + {_RV}) + 1.0 / (30 + row_number() OVER "
        "(PARTITION BY query_id ORDER BY text_score DESC NULLS FIRST, id))"),
    "hybrid_rrf_classic": _cands("distance", "covers") + _final(
        f"CASE WHEN vec_score IS NULL THEN 0 ELSE 1.0 / (60 + {_RV}) END + "
        "CASE WHEN text_score IS NULL THEN 0 ELSE 1.0 / (30 + row_number() OVER "
        "(PARTITION BY query_id ORDER BY text_score DESC NULLS LAST, id)) END"),
    "hybrid_max_norm": _cands("1 - distance", "normed") + _final(MAX_NORM_SQL),
}

QUERIES = {
    "hybrid_rrf_postgres": hybrid_rrf_postgres,
    "hybrid_rrf_classic": hybrid_rrf_classic,
    "hybrid_max_norm": hybrid_max_norm,
}
