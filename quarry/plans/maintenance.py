"""Registered queries over records, judgements and refined questions that need several operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import format_fact, payload_field
from quarry.operators.chunking import fixed_window_chunks
from quarry.operators.context import citations
from quarry.operators.evaluate import attach_judgements, rank_and_flatten, validate_labels
from quarry.operators.fusion import search
from quarry.operators.history import append_turn, with_defaults
from quarry.operators.loading import file_records
from quarry.operators.refine import refined_terms
from quarry.operators.store import delete_records
from quarry.operators.text_search import text_search
from quarry.plans.common import QUERY_SET_CTE, RECORDS_CTE, rounded
from quarry.plans.history import SQL as HISTORY_SQL
from quarry.plans.hybrid import LIMIT, RESULTS_CTES
from quarry.plans.text import TEXT_CTES, TOP
from quarry.sources.tables import query_set, read_table, records


def search_entry(spark: SparkSession, sf: str) -> DataFrame:
    out = search(records(spark, sf), query_set(spark, sf), LIMIT, use_normalization=True)
    return out.select("query_id", "id", "rank", rounded("score"), F.length("content").alias("content_len"))


def search_filtered(spark: SparkSession, sf: str) -> DataFrame:
    """With filters and a least score switched on."""
    out = search(records(spark, sf), query_set(spark, sf), LIMIT, use_normalization=True, apply_filters=True,
                 filters=[["lang:fr"], ["lang:es"]], min_relevance=0.7)
    return out.select("query_id", "id", "rank", rounded("score"))


def citations_by_source(spark: SparkSession, sf: str) -> DataFrame:
    """Hits grouped under the source of their payload: several partitions to a source."""
    hits = search(records(spark, sf), query_set(spark, sf), 3 * LIMIT, use_normalization=True)
    c = citations(hits.withColumn("src", payload_field("source")), source="src")
    return c.select("query_id", "source_name", rounded("relevance"), F.size("partitions").alias("n_partitions"),
                    F.sha2(F.concat_ws("|", F.transform("partitions", lambda p: p["text"])), 256).alias("texts_sha256"))


def judged_results(spark: SparkSession, sf: str) -> DataFrame:
    """Ranked results with judgements for the odd ranks only; off-scale labels are found."""
    flat = rank_and_flatten(citations(search(records(spark, sf), query_set(spark, sf), LIMIT, use_normalization=True)))
    labels = flat.where("rank % 2 = 1").select("query_id", "rank", (F.col("query_id") % 4).cast("int").alias("is_relevant"))
    judged = attach_judgements(flat, labels)
    off = validate_labels(judged).select("query_id", "rank", F.lit(True).alias("off_scale"))
    return judged.join(off, ["query_id", "rank"], "left").select(
        "query_id", "rank", "document_id", "is_relevant", F.coalesce("off_scale", F.lit(False)).alias("off_scale"))


def refined_search(spark: SparkSession, sf: str) -> DataFrame:
    """Full-text search with the two weightiest terms of every question."""
    q = read_table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    t = refined_terms(q, read_table(spark, sf, "documents")).where("term_rank <= 2")
    refined = t.groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_list("term")), " ").alias("query_text"))
    out = text_search(records(spark, sf), refined, TOP)
    return out.select("query_id", "id", rounded("text_score"), "text_rank")


def delete_listed_records(spark: SparkSession, sf: str) -> DataFrame:
    low = read_table(spark, sf, "labels").where("quality = 0").select(F.col("doc_id").cast("string").alias("id"))
    return delete_records(records(spark, sf), low).select("id")


def append_turns(spark: SparkSession, sf: str) -> DataFrame:
    """A new exchange for every third conversation and for one that does not exist yet."""
    conv = read_table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    new = conv.select("conv_id").distinct().where("conv_id % 3 = 0").unionByName(
        conv.agg((F.max("conv_id") + 1).alias("conv_id")))
    turns = new.select("conv_id", F.concat(F.lit("q"), "conv_id").alias("user_text"), F.lit("a").alias("assistant_text"))
    return append_turn(conv, turns).select("conv_id", "turn", "role", F.length("text").alias("text_len"))


def function_messages(spark: SparkSession, sf: str) -> DataFrame:
    """Messages whose lines are items (their kind from their length): those with a function item,
    as the default of the history operators derives it."""
    line = lambda x: F.struct(F.when(F.length(x) % 7 == 0, "FunctionCallContent").when(
        F.length(x) % 11 == 0, "FunctionResultContent").when(F.length(x) % 13 > 0, "TextContent").alias("kind"), x.alias("text"))
    conv = read_table(spark, sf, "conversations").withColumn("items", F.transform(F.split("text", "\n", -1), line))
    return with_defaults(conv).where("has_function_item").select("conv_id", "turn")


def fact_blocks(spark: SparkSession, sf: str) -> DataFrame:
    d = read_table(spark, sf, "documents")
    fact = format_fact(F.concat(F.lit("v"), F.col("doc_id").cast("string")), F.col("source"), F.col("text"))
    return d.select("doc_id", F.sha2(fact, 256).alias("fact_sha256"))


def file_records_q(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as text files -> chunk records with document tags."""
    files = read_table(spark, sf, "documents").select(
        F.concat(F.lit("/in/"), "source", F.lit("/"), F.col("doc_id").cast("string"),
                 F.when(F.col("doc_id") % 10 == 0, ".bin").otherwise(".txt")).alias("path"),
        F.encode("text", "UTF-8").alias("content"))
    out = file_records(files, text_chunks=fixed_window_chunks, tags=["kind:text"])
    return out.select("id", F.array_join("tags", "|").alias("tags"), F.sha2("content", 256).alias("content_sha256"),
                      payload_field("file").alias("file"))


def _results(limit: int) -> str:
    """``results (query_id, id, score, rank)`` of the max-normalised hybrid search."""
    return RESULTS_CTES.replace(f"<= {3 * LIMIT})", f"<= {3 * limit})").replace(f"rank <= {LIMIT})", f"rank <= {limit})")


_FILTER = "(list_contains(r.tags, 'lang:fr') OR list_contains(r.tags, 'lang:es'))"
_REFINED = HISTORY_SQL["refined_terms"].replace("term_rank <= 5", "term_rank <= 2")

SQL = {
    "search_entry": f"""{_results(LIMIT)}
SELECT query_id, results.id, rank, round(score, 6) + 0.0 AS score, length(r.content) AS content_len
FROM results JOIN records r ON r.id = results.id""",
    "search_filtered": f"""{RESULTS_CTES.replace('records AS (', 'all_records AS (', 1).replace(
        'query_set AS (', f'records AS (SELECT * FROM all_records r WHERE {_FILTER}), query_set AS (', 1)}
SELECT query_id, id, rank, round(score, 6) + 0.0 AS score FROM results WHERE score >= 0.7""",
    "citations_by_source": f"""{_results(3 * LIMIT)}
SELECT query_id, json_extract_string(r.payload, '$.source') AS source_name, round(max(score), 6) + 0.0 AS relevance,
       count(*) AS n_partitions, sha256(string_agg(r.content, '|' ORDER BY score DESC, r.content DESC)) AS texts_sha256
FROM results JOIN records r ON r.id = results.id GROUP BY 1, 2""",
    "judged_results": f"""{_results(LIMIT)}
SELECT query_id, rank, id AS document_id, CASE WHEN rank % 2 = 1 THEN query_id % 4 END AS is_relevant,
       coalesce(rank % 2 = 1 AND query_id % 4 = 2, false) AS off_scale FROM results""",
    "refined_search": f"""WITH rt AS ({_REFINED}), {TEXT_CTES.replace(
        QUERY_SET_CTE, "query_set AS (SELECT query_id, string_agg(term, ' ' ORDER BY term) AS query_text FROM rt GROUP BY 1)")}
SELECT query_id, id, round(score, 6) + 0.0 AS text_score,
       row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS text_rank FROM covers QUALIFY text_rank <= {TOP}""",
    "delete_listed_records": f"""WITH {RECORDS_CTE}
SELECT id FROM records WHERE id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE quality = 0)""",
    "append_turns": """WITH l AS (SELECT conv_id, max(turn) AS last FROM conversations GROUP BY 1),
n AS (SELECT conv_id, last + 1 AS base FROM l WHERE conv_id % 3 = 0
      UNION ALL SELECT max(conv_id) + 1, 0 FROM conversations)
SELECT conv_id, turn, role, length(text) AS text_len FROM conversations
UNION ALL SELECT conv_id, base, 'user', length('q' || CAST(conv_id AS VARCHAR)) FROM n
UNION ALL SELECT conv_id, base + 1, 'assistant', 1 FROM n""",
    "function_messages": """SELECT DISTINCT conv_id, turn FROM (
  SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS item FROM conversations)
WHERE length(item) % 7 = 0 OR length(item) % 11 = 0""",
    "fact_blocks": """SELECT doc_id, sha256('=== Last update:v' || CAST(doc_id AS VARCHAR) || ' ===' || chr(10)
       || 'Source:' || source || chr(10) || text || chr(10)) AS fact_sha256 FROM documents""",
    "file_records": """WITH w AS (
  SELECT '/in/' || source || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS path, text,
         CAST(doc_id AS VARCHAR) || '.txt' AS name,
         unnest(range(0, CASE WHEN length(text) > 0
           THEN 1 + CAST(ceil(greatest(length(text) - 1000, 0) / 800.0) AS BIGINT) ELSE 0 END)) AS k
  FROM documents WHERE doc_id % 10 <> 0)
SELECT md5(path || '/' || CAST(k AS VARCHAR)) AS id, '__document_id:' || path || '|kind:text' AS tags,
       sha256(substring(text, k * 800 + 1, 1000)) AS content_sha256,
       name || '.partition.' || CAST(k AS VARCHAR) || '.txt' AS file FROM w""",
}

QUERIES = {
    "search_entry": search_entry,
    "search_filtered": search_filtered,
    "citations_by_source": citations_by_source,
    "judged_results": judged_results,
    "refined_search": refined_search,
    "delete_listed_records": delete_listed_records,
    "append_turns": append_turns,
    "function_messages": function_messages,
    "fact_blocks": fact_blocks,
    "file_records": file_records_q,
}
