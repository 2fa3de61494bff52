"""Result shaping: citations grouped by source and the per-question context block."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import clean_text
from quarry.operators.store import document_id

NO_RESULT = "Aucun result trouvé."   # fixed value: text emitted when a question has no result
BULLET = "—— "                       # fixed value: prefix of one partition line


def citations(results: DataFrame, source: str | None = None,
              last_update: str | None = None) -> DataFrame:
    """``(query_id, source_name, relevance, partitions)``: the scored records of
    each query grouped under their source (the document id tag by default);
    partitions ``array<struct<relevance, text, last_update>>`` sorted by
    relevance descending. Groups are bounded by the search limit."""
    src = F.col(source) if source else document_id("tags")
    upd = F.col(last_update) if last_update else F.lit(None).cast("string")
    parts = results.select("query_id", src.alias("source_name"),
                           F.struct(F.col("score").alias("relevance"),
                                    F.col("content").alias("text"),
                                    upd.alias("last_update")).alias("p"))
    return (parts.groupBy("query_id", "source_name")
            .agg(F.max("p.relevance").alias("relevance"),
                 F.sort_array(F.collect_list("p"), asc=False).alias("partitions")))


def context_blocks(cits: DataFrame, questions: DataFrame, instructions: str = "") -> DataFrame:
    """``(query_id, context)``: instructions, ``[QUESTION]``, the question, then
    ``[SEARCH RESULTS]`` with one ``Source:`` paragraph per citation (best
    first) and one line per non-blank cleaned partition; a question without
    results gets the no-result line. Blank questions are rejected (NULL)."""
    line = lambda p: F.when(clean_text(p["text"]) != "",
                            F.concat(F.lit(BULLET), clean_text(p["text"]), F.lit("\n")))
    per_cit = cits.select(
        "query_id", "relevance", "source_name",
        F.concat(F.lit("Source: "), F.coalesce("source_name", F.lit("")), F.lit("\n"),
                 F.array_join(F.transform("partitions", line), ""), F.lit("\n")).alias("block"))
    blocks = (per_cit.groupBy("query_id")
              .agg(F.sort_array(F.collect_list(F.struct(
                  (-F.col("relevance")).alias("k"), F.col("source_name"), F.col("block")))).alias("b")))
    head = F.concat(F.lit(instructions + "\n[QUESTION]\n"), F.col("query_text"), F.lit("\n\n"))
    body = F.when(F.col("b").isNull() | (F.size("b") == 0), F.lit(NO_RESULT + "\n")).otherwise(
        F.concat(F.lit("[SEARCH RESULTS]\n"), F.array_join(F.transform("b", lambda x: x["block"]), "")))
    q = questions.where(F.col("query_text").isNotNull() & (F.trim("query_text") != ""))
    return q.join(blocks, "query_id", "left").select("query_id", F.concat(head, body).alias("context"))
