"""Toxicity: a factorization machine over hashed terms.

Features of a text are its distinct lower-cased terms (runs of letters and digits)
and one feature for the power of two of its length, so the machine can learn both
pairs of terms and how much a term means in a text of that length.  Labels,
language, source and id are never features.

Scale: see ``quarry.llm.fm``; scoring needs no shuffle.

Defined cases: NULL and empty texts have the length feature only and get a score
like any other; repeated rows get equal scores; without labels of both classes the
score is the smoothed share of the one class; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm import fm
from quarry.llm.common import id_crc32, quoted, whole

THRESHOLD = 0.7


def features(text: Column) -> Column:
    """Hash buckets of a text's features."""
    body = whole(text)
    terms = F.filter(F.split(F.lower(body), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    size = F.concat(F.lit("\tlength "), F.ceil(F.log2(F.length(body) + 1)).cast("string"))
    return fm.buckets(F.concat(F.array(size), terms))


def held_out(id_col: Column) -> Column:
    """Rows whose labels are never learned from."""
    return id_crc32(id_col) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
        label_id: str = "doc_id", label: str = "toxic") -> fm.Machine:
    train = docs.where(~held_out(quoted(id_col))).select(quoted(id_col).alias("id"), quoted(text_col).alias("text"))
    return fm.fit(train, labels.select(quoted(label_id).alias("id"), quoted(label).alias("y")), features(F.col("text")))


def toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
             threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: (doc_id, held_out, score, predicted)."""
    model = fit(docs, labels, id_col=id_col, text_col=text_col)
    rows = docs.select(quoted(id_col).alias("doc_id"), held_out(quoted(id_col)).alias("held_out"),
                       features(quoted(text_col)).alias("x"))
    return fm.scored(rows, model).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                  threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below the threshold."""
    model = fit(docs, labels, id_col=id_col, text_col=text_col)
    rows = fm.scored(docs.withColumn("__q_x", features(quoted(text_col))), model, "__q_x", "__q_score")
    return rows.where(F.col("__q_score") < threshold).select(*[quoted(c) for c in docs.columns])
