"""Registered full-text queries: AND-match and cover-density rank."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.functions import french
from quarry.operators.postings import PostingsIndex
from quarry.operators.text_search import LexemeIndex, text_matches, text_search
from quarry.plans.common import QUERY_SET_CTE, RECORDS_CTE, rounded, tokens_cte
from quarry.plans.french_sql import stem_ctes
from quarry.sources.tables import derived, query_set, records

TOP = 20  # ranked matches reported per query


def text_index(spark: SparkSession, sf: str, stemmed: bool = False) -> PostingsIndex:
    """The postings of the records: built once per session and state of the tables."""
    stemmer = french.stem if stemmed else None
    return derived(spark, sf, ["documents"], "text-index" + ("-stemmed" if stemmed else ""),
                   lambda path: PostingsIndex.save(records(spark, sf).select("id", "content"), path, stemmer=stemmer))


def text_match_all(spark: SparkSession, sf: str) -> DataFrame:
    return text_matches(LexemeIndex.build(records(spark, sf)), query_set(spark, sf))


def _ranked(spark: SparkSession, sf: str, **options) -> DataFrame:
    out = text_search(records(spark, sf), query_set(spark, sf), TOP, **options)
    return out.select("query_id", "id", rounded("text_score"), "text_rank")


def text_rank(spark: SparkSession, sf: str) -> DataFrame:
    return _ranked(spark, sf)


def text_rank_norm(spark: SparkSession, sf: str) -> DataFrame:
    return _ranked(spark, sf, length_norm=True)


def text_match_index(spark: SparkSession, sf: str) -> DataFrame:
    return text_matches(text_index(spark, sf), query_set(spark, sf))


def text_rank_index(spark: SparkSession, sf: str) -> DataFrame:
    """``text_rank`` from the saved postings."""
    return _ranked(spark, sf, index=text_index(spark, sf))


def text_rank_stemmed(spark: SparkSession, sf: str) -> DataFrame:
    """Words of records and questions by their French stems, from saved postings."""
    return _ranked(spark, sf, index=text_index(spark, sf, stemmed=True))


# SQL building blocks: tokens, query lexemes, matches, hits and covers.
TEXT_CTES = f"""{RECORDS_CTE}, {QUERY_SET_CTE},
{tokens_cte('dtok', 'records', 'id', 'content')},
{tokens_cte('qtok', 'query_set', 'query_id', 'query_text')},
qlex AS (SELECT key AS query_id, lexeme,
                row_number() OVER (PARTITION BY key ORDER BY lexeme) - 1 AS term
         FROM (SELECT DISTINCT key, lexeme FROM qtok)),
qn AS (SELECT query_id, count(*) AS n FROM qlex GROUP BY query_id),
dlex AS (SELECT DISTINCT key AS id, lexeme FROM dtok),
matches AS (
  SELECT m.query_id, m.id FROM (
    SELECT q.query_id, d.id, count(*) AS c FROM dlex d JOIN qlex q USING (lexeme) GROUP BY 1, 2) m
  JOIN qn USING (query_id) WHERE m.c = qn.n),
hits AS (
  SELECT m.query_id, m.id, t.pos, q.term,
         row_number() OVER (PARTITION BY m.query_id, m.id ORDER BY t.pos) - 1 AS i
  FROM matches m JOIN dtok t ON t.key = m.id
  JOIN qlex q ON q.query_id = m.query_id AND q.lexeme = t.lexeme),
lastseen AS (
  SELECT h.query_id, h.id, h.i, h.pos, q.term, max(h2.i) AS last_i
  FROM hits h JOIN qlex q ON q.query_id = h.query_id
  LEFT JOIN hits h2 ON h2.query_id = h.query_id AND h2.id = h.id AND h2.term = q.term AND h2.i <= h.i
  GROUP BY h.query_id, h.id, h.i, h.pos, q.term),
ends AS (
  SELECT query_id, id, i, pos, min(last_i) AS s, count(last_i) AS nseen
  FROM lastseen GROUP BY query_id, id, i, pos),
complete AS (
  SELECT e.*, lag(e.s) OVER (PARTITION BY e.query_id, e.id ORDER BY e.i) AS prev_s
  FROM ends e JOIN qn USING (query_id) WHERE e.nseen = qn.n),
covers AS (
  SELECT c.query_id, c.id,
         sum(CASE WHEN c.prev_s IS NULL OR c.s > c.prev_s
                  THEN 0.1 / (1 + ((c.pos - hs.pos) - (c.i - c.s))) ELSE 0 END) AS score
  FROM complete c JOIN hits hs ON hs.query_id = c.query_id AND hs.id = c.id AND hs.i = c.s
  GROUP BY c.query_id, c.id),
doclen AS (SELECT key AS id, count(*) AS n_pos FROM dtok GROUP BY key)"""

SQL = {
    "text_match_all": f"WITH {TEXT_CTES}\nSELECT query_id, id FROM matches",
    "text_rank": f"""WITH {TEXT_CTES}
SELECT query_id, id, round(score, 6) + 0.0 AS text_score,
       row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS text_rank
FROM covers QUALIFY text_rank <= {TOP}""",
    "text_rank_norm": f"""WITH {TEXT_CTES}, normed AS (
  SELECT c.query_id, c.id, c.score / ln(1 + d.n_pos) AS score FROM covers c JOIN doclen d USING (id))
SELECT query_id, id, round(score, 6) + 0.0 AS text_score,
       row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS text_rank
FROM normed QUALIFY text_rank <= {TOP}""",
}

# records and questions by stems: every word of either is stemmed once, in SQL
_WORDS = ", ".join([tokens_cte("dtok0", "records", "id", "content"), tokens_cte("qtok0", "query_set", "query_id", "query_text"),
                    "vocabulary AS (SELECT DISTINCT lexeme AS w FROM (SELECT lexeme FROM dtok0 UNION ALL SELECT lexeme FROM qtok0))",
                    stem_ctes("vocabulary"),
                    *[f"{t} AS (SELECT key, stem AS lexeme, pos FROM {t}0 JOIN stems ON w = lexeme WHERE stem <> '')" for t in ("dtok", "qtok")]])
_PLAIN = f"""{tokens_cte('dtok', 'records', 'id', 'content')},
{tokens_cte('qtok', 'query_set', 'query_id', 'query_text')}"""
assert _PLAIN in TEXT_CTES
SQL["text_rank_stemmed"] = SQL["text_rank"].replace(_PLAIN, _WORDS)
SQL |= {"text_match_index": SQL["text_match_all"], "text_rank_index": SQL["text_rank"]}

QUERIES = {
    "text_match_all": text_match_all,
    "text_rank": text_rank,
    "text_rank_norm": text_rank_norm,
    "text_match_index": text_match_index,
    "text_rank_index": text_rank_index,
    "text_rank_stemmed": text_rank_stemmed,
}
