"""Registered conversation-history, query-refinement and streaming queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.history import clean_history, history_tail, reduce_history, summary_input
from quarry.operators.refine import RUN_TOKEN, key_expressions, refined_terms
from quarry.plans.common import STOP_SQL, rounded, tokens_cte
from quarry.session import scratch_path
from quarry.sources.tables import read_table
from quarry.streaming.ingest import read_merged, start_ingest

TARGET = 5
TAIL = 4


#: The conversations with blank messages, and function messages, derived from their keys,
#: so that cleaning leaves gaps and the rows of these queries can fail.
CONV_COLUMNS = ["conv_id", "turn", "role", "CASE WHEN (conv_id + turn) % 4 = 1 THEN '  ' ELSE text END AS text",
                "(conv_id * 3 + turn) % 5 = 0 AS has_function_item"]
CONV_SQL = ", ".join(CONV_COLUMNS)


def _conv(spark, sf):
    return read_table(spark, sf, "conversations").selectExpr(*CONV_COLUMNS)


def _cleaned(spark, sf):
    return clean_history(_conv(spark, sf))


def clean_history_q(spark: SparkSession, sf: str) -> DataFrame:
    return clean_history(_conv(spark, sf)).select("conv_id", "turn", "role")


def history_tail_q(spark: SparkSession, sf: str) -> DataFrame:
    return history_tail(_cleaned(spark, sf), TAIL).select("conv_id", "turn", "role")


def reduce_history_q(spark: SparkSession, sf: str) -> DataFrame:
    return reduce_history(_cleaned(spark, sf), TARGET).select("conv_id", "out_pos", "turn", "role", "kind")


def summary_input_q(spark: SparkSession, sf: str) -> DataFrame:
    return summary_input(_cleaned(spark, sf), TARGET).select("conv_id", "turn", "role")


def refined_terms_q(spark: SparkSession, sf: str) -> DataFrame:
    q = read_table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"),
                                                  F.col("text").alias("query_text"))
    out = refined_terms(q, read_table(spark, sf, "documents"))
    return out.select("query_id", "term_rank", "term", rounded("idf"))


def key_expressions_q(spark: SparkSession, sf: str) -> DataFrame:
    q = read_table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    out = key_expressions(q, read_table(spark, sf, "documents"))
    return out.select("query_id", "term_rank", "term", "n_words", rounded("score"))


def stream_ingest(spark: SparkSession, sf: str) -> DataFrame:
    base = scratch_path(spark, "stream-ingest")
    q = start_ingest(spark, sf, f"{base}/table", f"{base}/checkpoint")
    q.awaitTermination()
    return read_merged(spark, f"{base}/table").select(
        "id", "parent_id", "name", "size", "partition_number", "content_sha256")


_CLEANED = f"""raw AS (SELECT {CONV_SQL} FROM conversations),
msgs AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos,
                count(*) OVER (PARTITION BY conv_id) AS n
         FROM raw WHERE regexp_matches(text, '\\S'))"""

# positions are counted here message by message, on the cleaned conversations
_PTS = f"""{_CLEANED},
sys AS (SELECT conv_id, max(n) AS n, min(CASE WHEN role = 'system' THEN pos END) AS first_system FROM msgs GROUP BY conv_id),
goal AS (SELECT *, {TARGET} - CASE WHEN first_system IS NULL THEN 0 ELSE 1 END AS t FROM sys),
tailed AS (
  SELECT g.conv_id, g.first_system,
         max(CASE WHEN NOT m.has_function_item AND m.pos <= least(g.n - g.t, g.n - 1) THEN m.pos END) AS at,
         max(CASE WHEN NOT m.has_function_item AND m.role = 'user' AND m.pos >= g.n - g.t
                   AND m.pos <= least(g.n - g.t, g.n - 1) THEN m.pos END) AS at_user
  FROM goal g JOIN msgs m USING (conv_id) WHERE g.n - g.t > 0 GROUP BY g.conv_id, g.first_system),
pts AS (SELECT s.conv_id, s.first_system, coalesce(t.at_user, t.at) AS truncation FROM sys s LEFT JOIN tailed t USING (conv_id))"""

def _grams(name: str, source: str, key: str) -> str:
    """Runs of 1 to 3 kept words with their first place."""
    parts = [f"""SELECT key, {n} AS n, i AS place, {" || ' ' || ".join(f"plain[i + {j}]" for j in range(n))} AS expression,
       {" || ' ' || ".join(f"t[i + {j}]" for j in range(n))} AS surface FROM (
  SELECT *, unnest(range(1, len(t) - {n - 2})) AS i FROM {name}_t)
  WHERE {" AND ".join(f"kept[i + {j}]" for j in range(n))}""" for n in (1, 2, 3)]
    return f"""{name}_t AS (SELECT key, t, plain, list_transform(plain, lambda w: regexp_matches(w, '^[\\p{{L}}\\p{{N}}]') AND w NOT IN {STOP_SQL}) AS kept
  FROM (SELECT *, list_transform(t, lambda w: lower(w)) AS plain FROM (
    SELECT {key} AS key, regexp_extract_all(coalesce(text, ''), '{RUN_TOKEN}') AS t FROM {source}))),
{name} AS ({" UNION ALL ".join(parts)})"""


SQL = {
    "key_expressions": f"""WITH {_grams('dg', 'documents', 'doc_id')},
{_grams('qg', 'benchmark', 'item_id')},
found AS (SELECT key AS query_id, n, expression, min(place) AS place, arg_min(surface, place) AS surface FROM qg GROUP BY 1, 2, 3),
counts AS (SELECT expression, count(*) AS f, count(DISTINCT key) AS df FROM dg
           WHERE expression IN (SELECT expression FROM found) GROUP BY 1),
nd AS (SELECT count(*) AS nd FROM documents),
scored AS (SELECT query_id, n, expression, place, surface, coalesce(f, 0) + 1 AS f1, ln((1.0 + nd) / (1.0 + coalesce(df, 0))) AS idf
           FROM found LEFT JOIN counts USING (expression) CROSS JOIN nd),
standing AS (SELECT * FROM scored WHERE n = 1 OR f1 > 2
             OR len(list_filter(string_split(surface, ' '), lambda w: NOT regexp_matches(w, '^\\p{{Lu}}'))) = 0),
inner_parts AS (
  SELECT DISTINCT query_id, expression AS outer_expression, f1, w[i + 1] AS expression FROM (
    SELECT *, unnest(range(0, n)) AS i FROM (SELECT *, string_split(expression, ' ') AS w FROM standing WHERE n > 1))
  UNION SELECT DISTINCT query_id, expression, f1, w[i + 1] || ' ' || w[i + 2] FROM (
    SELECT *, unnest(range(0, 2)) AS i FROM (SELECT *, string_split(expression, ' ') AS w FROM standing WHERE n = 3))),
around AS (SELECT query_id, expression, avg(f1) AS around FROM inner_parts GROUP BY 1, 2),
kept AS (SELECT s.*, log2(n + 1.0) * idf AS score FROM standing s LEFT JOIN around a USING (query_id, expression)
         WHERE around IS NULL OR f1 > around),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, place, n DESC, expression) AS term_rank FROM kept)
SELECT query_id, term_rank, surface AS term, n AS n_words, round(score, 6) + 0.0 AS score FROM ranked WHERE term_rank <= 5""",
    "clean_history": f"WITH {_CLEANED}\nSELECT conv_id, turn, role FROM msgs",
    "history_tail": f"""WITH {_CLEANED}
SELECT conv_id, turn, role FROM msgs WHERE pos >= n - {TAIL}""",
    "reduce_history": f"""WITH {_PTS},
r AS (
  SELECT m.conv_id, m.turn, m.role,
         CASE WHEN p.truncation IS NULL THEN 'kept' WHEN m.pos = p.first_system THEN 'system'
              WHEN m.pos < p.truncation AND m.has_function_item THEN 'function'
              WHEN m.pos >= p.truncation THEN 'tail' END AS kind
  FROM msgs m JOIN pts p USING (conv_id)
  UNION ALL
  SELECT conv_id, NULL, 'assistant', 'summary' FROM pts WHERE truncation IS NOT NULL),
g AS (SELECT *, CASE kind WHEN 'system' THEN 0 WHEN 'summary' THEN 2 WHEN 'function' THEN 3 ELSE 4 END AS grp
      FROM r WHERE kind IS NOT NULL)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY grp, turn) - 1 AS out_pos, turn, role, kind FROM g""",
    "summary_input": f"""WITH {_PTS}
SELECT m.conv_id, m.turn, m.role FROM msgs m JOIN pts p USING (conv_id)
WHERE m.pos < p.truncation AND NOT m.has_function_item""",
    "refined_terms": f"""WITH {tokens_cte('dtok', 'documents', 'doc_id', 'text')},
{tokens_cte('qtok', 'benchmark', 'item_id', 'text')},
dfs AS (SELECT lexeme, count(DISTINCT key) AS df FROM dtok GROUP BY lexeme),
nd AS (SELECT count(*) AS n FROM documents),
q AS (SELECT DISTINCT key AS query_id, lexeme FROM qtok),
s AS (SELECT q.query_id, q.lexeme, ln((1.0 + nd.n) / (1.0 + coalesce(dfs.df, 0))) AS idf
      FROM q LEFT JOIN dfs USING (lexeme) CROSS JOIN nd),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY idf DESC, lexeme) AS term_rank FROM s)
SELECT query_id, term_rank, lexeme AS term, round(idf, 6) + 0.0 AS idf FROM r WHERE term_rank <= 5""",
    "stream_ingest": """WITH w AS (
  SELECT doc_id, text, unnest(range(0, CASE WHEN length(text) > 0
         THEN 1 + CAST(ceil(greatest(length(text) - 1000, 0) / 800.0) AS BIGINT) ELSE 0 END)) AS k
  FROM documents),
c AS (SELECT doc_id, k AS partition_number, substring(text, k * 800 + 1, 1000) AS chunk FROM w)
SELECT md5(CAST(doc_id AS VARCHAR) || '/' || CAST(partition_number AS VARCHAR)) AS id,
       CAST(doc_id AS VARCHAR) AS parent_id,
       CAST(doc_id AS VARCHAR) || '.partition.' || CAST(partition_number AS VARCHAR) || '.txt' AS name,
       length(chunk) AS size, partition_number, sha256(chunk) AS content_sha256 FROM c""",
}

QUERIES = {
    "clean_history": clean_history_q,
    "history_tail": history_tail_q,
    "reduce_history": reduce_history_q,
    "summary_input": summary_input_q,
    "refined_terms": refined_terms_q,
    "key_expressions": key_expressions_q,
    "stream_ingest": stream_ingest,
}
