"""Shared pieces of the registered queries and their SQL oracles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.stopwords import sql_list

DIGITS = 6  # scores are compared after rounding to this many digits


def rounded(c: str | Column, name: str | None = None) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    # "+ 0.0" turns a rounded -0.0 into 0.0 so hashes of equal values agree
    out = F.round(col.cast("double"), DIGITS) + F.lit(0.0)
    return out.alias(name or (c if isinstance(c, str) else "value"))


# DuckDB fragments ------------------------------------------------------------

RECORDS_CTE = """records AS (
  SELECT CAST(d.doc_id AS VARCHAR) AS id,
         CAST(e.embedding AS DOUBLE[]) AS embedding,
         ['lang:' || d.lang, 'source:' || d.source,
          '__document_id:' || CAST(d.doc_id AS VARCHAR)] AS tags,
         d.text AS content,
         CAST(json_object('source', d.source, 'n_chars', d.n_chars) AS VARCHAR) AS payload
  FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id)"""

QUERY_SET_CTE = """query_set AS (
  SELECT b.item_id AS query_id, b.text AS query_text,
         CAST(e.embedding AS DOUBLE[]) AS query_vec
  FROM benchmark b LEFT JOIN embeddings e ON b.item_id = e.vec_id)"""

SCORED_CTE = """scored AS (
  SELECT q.query_id, r.id,
         1 - list_dot_product(q.query_vec, r.embedding)
             / (sqrt(list_dot_product(q.query_vec, q.query_vec))
                * sqrt(list_dot_product(r.embedding, r.embedding))) AS distance
  FROM query_set q, records r WHERE r.embedding IS NOT NULL AND q.query_vec IS NOT NULL {where})"""

STOP_SQL = sql_list()


def tokens_cte(name: str, source: str, key: str, text: str) -> str:
    """Word tokens with 1-based positions; stop words and empty strings dropped
    (positions still count them)."""
    return f"""{name} AS (
  SELECT {key} AS key, tok AS lexeme, pos FROM (
    SELECT {key}, unnest(regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{N}}]+')) AS tok,
           unnest(range(1, len(regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{N}}]+')) + 1)) AS pos
    FROM {source})
  WHERE tok <> '' AND tok NOT IN {STOP_SQL})"""
