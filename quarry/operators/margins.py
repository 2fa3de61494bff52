"""Repeated page margins (running headers / footers) removed from layout blocks.

Input blocks ``(doc_id, page_no, page_height, block_no, text, top, bottom)``.
A block whose top edge is above 85 % of the page height is in the top band,
otherwise one whose bottom edge is below 15 % is in the bottom band (strict
comparisons).  A trimmed text seen at least ``min_count`` times in one band of
a document is removed from every page of that document; the kept blocks of a
page are concatenated in block order without separator.

Plan: one aggregation on ``(doc_id, band, text)`` with partial combine, a left
join on ``(doc_id, text)`` and one per-page ordered concatenation of the blocks
without a match (pages are small, and pages without any stay).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOP = 0.85
BOTTOM = 0.15
MIN_COUNT = 3


def _trim(c):
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def margin_band(top="top", bottom="bottom", height="page_height", top_frac=TOP,
                bottom_frac=BOTTOM):
    return (F.when(F.col(top) > F.col(height) * top_frac, F.lit("top"))
            .when(F.col(bottom) < F.col(height) * bottom_frac, F.lit("bottom")))


def repeated_margins(blocks: DataFrame, top_frac: float = TOP, bottom_frac: float = BOTTOM,
                     min_count: int = MIN_COUNT) -> DataFrame:
    """``(doc_id, text)`` of the texts repeated in a margin band."""
    b = blocks.select("doc_id", _trim(F.col("text")).alias("text"),
                      margin_band(top_frac=top_frac, bottom_frac=bottom_frac).alias("band"))
    return (b.where(F.col("band").isNotNull() & (F.col("text") != ""))
            .groupBy("doc_id", "band", "text").count()
            .where(F.col("count") >= min_count)
            .select("doc_id", "text").distinct())


def remove_repeated_margins(blocks: DataFrame, top_frac: float = TOP, bottom_frac: float = BOTTOM,
                            min_count: int = MIN_COUNT) -> DataFrame:
    """``(doc_id, page_no, text)``: page texts without repeated margins; every
    page of the input appears (possibly with an empty text)."""
    common = repeated_margins(blocks, top_frac, bottom_frac, min_count).withColumn("repeated", F.lit(True))
    b = blocks.select("doc_id", "page_no", "block_no", _trim(F.col("text")).alias("text"))
    kept = F.when(F.col("repeated").isNull() & (F.col("text") != ""), F.struct("block_no", "text"))
    return (b.join(common, ["doc_id", "text"], "left").groupBy("doc_id", "page_no")
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(kept)), lambda x: x["text"]), "").alias("text")))


def blocks_from_lines(docs: DataFrame, lines_per_page: int = 10, page_height: float = 100.0,
                      key: str = "doc_id", text: str = "text") -> DataFrame:
    """Layout blocks from plain text: every line is a block, ``lines_per_page``
    lines per page, stacked from the top (line 0 spans 100..90 of a 100 high page)."""
    slot_h = page_height / lines_per_page
    lines = docs.select(F.col(key).alias("doc_id"),
                        F.posexplode(F.split(F.col(text), "\n", -1)).alias("line_no", "text"))
    slot = F.col("line_no") % lines_per_page
    return lines.select(
        "doc_id", (F.col("line_no") / lines_per_page).cast("int").alias("page_no"),
        F.lit(page_height).alias("page_height"), slot.alias("block_no"), "text",
        (F.lit(page_height) - slot * slot_h).alias("top"),
        (F.lit(page_height) - (slot + 1) * slot_h).alias("bottom"))
