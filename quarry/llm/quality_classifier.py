"""Quality: a factorization machine over hashed words, structure statistics and metadata.

A text's features are its distinct lower-cased words and a bucket for each of its
structure statistics (symbols, capitals, exclamations, digits, repeated lines, words
and windows, word and line lengths) and of its size metadata, so the machine learns
which statistics matter together.  Pairs are scored in linear time by the
sum-of-squares identity.  Labels, language, source and id are never features.

Scale: see ``quarry.llm.fm``; scoring needs no shuffle.

Defined cases: NULL and empty texts have the statistics of a text without words and
get a score like any other; repeated rows get equal scores; without labels of both
classes the score is the smoothed share of the one class; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm import fm
from quarry.llm.common import WORD, id_crc32, let, quoted, whole, words
from quarry.llm.quality_rules import count_of, repeated_words

THRESHOLD = 0.3


def _step(value: Column, steps: int, most: float) -> Column:
    return F.floor(F.least(value, F.lit(most)) * steps).cast("string")


def statistics(text: Column) -> Column:
    """One feature string for the bucket of each statistic."""
    body = whole(text)

    def of(w: Column) -> Column:
        n = F.greatest(F.size(w), F.lit(1))
        chars = F.greatest(F.length(body), F.lit(1))
        letters = F.greatest(count_of(body, r"\p{L}+"), F.lit(1))
        repeated = F.size(w) - F.size(F.array_distinct(w))
        stutter = F.size(F.filter(w, lambda x, i: (i > 0) & (x == w[F.greatest(i - 1, F.lit(0))])))
        lines = F.filter(F.split(body, "\n", -1), lambda x: x.rlike(WORD))
        values = {
            "words": F.ceil(2 * F.log2(n)).cast("string"), "chars": F.ceil(F.log2(chars)).cast("string"),
            "symbols": _step(count_of(body, r"[#*$%&|<>]+") / n, 20, 2.0),
            "capitals": _step(count_of(body, r"\p{Lu}+") / letters, 20, 1.0),
            "exclaim": _step(count_of(body, "!+") / n, 20, 2.0), "digits": _step(count_of(body, r"\p{N}+") / chars, 20, 1.0),
            "letters": _step(letters / chars, 20, 1.0), "word_length": _step(chars / n, 1, 30.0),
            "repeated": _step(repeated / n, 10, 1.0), "stutter": _step(stutter / n, 10, 1.0),
            "windows": _step(repeated_words(w) / n, 10, 1.0),
            "lines": let(lines, lambda x: _step((F.size(x) - F.size(F.array_distinct(x))) / F.greatest(F.size(x), F.lit(1)), 10, 1.0)),
            "line_words": let(lines, lambda x: F.ceil(F.log2(n / F.greatest(F.size(x), F.lit(1)))).cast("string")),
        }
        return F.array(*[F.concat(F.lit(f"\t{k} "), v) for k, v in values.items()])

    return let(words(text), of)


def features(text: Column) -> Column:
    """Hash buckets of a text's features."""
    terms = F.filter(F.split(F.lower(whole(text)), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return fm.buckets(F.concat(statistics(text), terms))


def held_out(id_col: Column) -> Column:
    """Rows whose labels are never learned from."""
    return id_crc32(id_col) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
        label_id: str = "doc_id", label: str = "quality") -> fm.Machine:
    train = docs.where(~held_out(quoted(id_col))).select(quoted(id_col).alias("id"), quoted(text_col).alias("text"))
    return fm.fit(train, labels.select(quoted(label_id).alias("id"), quoted(label).alias("y")), features(F.col("text")))


def quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
            threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: (doc_id, held_out, score, predicted)."""
    model = fit(docs, labels, id_col=id_col, text_col=text_col)
    rows = docs.select(quoted(id_col).alias("doc_id"), held_out(quoted(id_col)).alias("held_out"),
                       features(quoted(text_col)).alias("x"))
    return fm.scored(rows, model).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
