"""Quality rules as a short-circuit cascade.

Every rule is a JVM expression that says whether it rejects a text.  On a sample
of the corpus each rule's cost (seconds of an aggregation over the sample) and
selectivity (share rejected) are measured; the rules then run in the order of
rejections per cost inside one CASE, so a text that an early rule rejects never
pays for the later ones.  The order changes the work, and which of several
rejecting rules is named, but never the verdict.

Scale: one pass over the texts, no shuffle, no Python; memory is bounded by one text.

Defined cases: a NULL text is an empty one; an empty text has no words, fails the
base rules and is not kept; repeated rows are judged alike; an empty table gives no
rows (the rules then stay in their written order).
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import SPACE, WORD, let, quoted, stored, whole, words

#: Words of a window whose repetition counts.
WINDOW = 8
#: Rows of the sample on which costs and selectivities are estimated.
SAMPLE_ROWS = 2_000


def without(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, pattern, "")


def count_of(text: Column, pattern: str) -> Column:
    """Characters of ``text`` in matches of ``pattern``."""
    return F.length(text) - F.length(without(text, pattern))


def repeated_words(word_list: Column, window: int = WINDOW) -> Column:
    """Words that lie in a window of ``window`` words found twice or more in the text,
    first finds included.  Windows are compared by 64-bit hash.

    A text without an equal pair (seen by one hash set) costs no sort; otherwise the
    windows are sorted with their places, and each repeated one covers
    ``min(window, distance from the one before)`` further words."""
    zero = F.lit(0).cast("long")

    def windows(hashes: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(hashes) - window),
                           lambda i: F.xxhash64(*[hashes[i + k] for k in range(window)]))

    def repeated_places(in_order: Column) -> Column:
        last = F.size(in_order) - 1
        twice = F.filter(in_order, lambda x, i: (
            ((i > 0) & (in_order[F.greatest(i - 1, F.lit(0))]["h"] == x["h"]))
            | ((i < last) & (in_order[F.least(i + 1, last)]["h"] == x["h"]))))
        return F.array_sort(F.transform(twice, lambda x: x["i"]))

    def covered(hashes: Column) -> Column:
        in_order = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.aggregate(
            let(in_order, repeated_places),
            F.struct(zero.alias("n"), F.lit(-window).alias("last")),
            lambda a, p: F.struct((a["n"] + F.least(F.lit(window), p - a["last"])).alias("n"), p.alias("last")),
            lambda a: a["n"])

    def count(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), zero).otherwise(covered(hashes))

    return F.when(F.size(word_list) <= window, zero).otherwise(
        let(let(F.transform(word_list, lambda w: F.xxhash64(w)), windows), count))


def with_statistics(df: DataFrame, text_col: str, prefix: str = "") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words."""
    text = whole(quoted(text_col))
    df = df.withColumn("__q_words", words(text))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    return df.withColumns({
        f"{prefix}n_words": F.size("__q_words").cast("long"),
        f"{prefix}word_chars": F.length(without(text, SPACE)).cast("long"),
        f"{prefix}n_symbols": count_of(text, r"[#*$%&|<>]+").cast("long"),
        f"{prefix}n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        f"{prefix}n_repeat_words": repeated_words(F.col("__q_words")),
    }).drop("__q_words")


@dataclass(frozen=True)
class Rule:
    """``rejects``: a boolean expression of a text column that is never NULL."""

    name: str
    rejects: Callable[[Column], Column]
    cost: float = 1.0
    share: float = 0.0


def _ratio(part: Column, of: Column) -> Column:
    return part / F.greatest(of, F.lit(1))


def standard_rules() -> list[Rule]:
    """Rules for web prose.  Shares are of words unless a name says otherwise."""
    n_words = lambda t: F.size(words(t))
    stutter = lambda w: F.size(F.filter(F.sequence(F.lit(1), F.size(w) - 1), lambda i: w[i] == w[i - 1]))
    return [
        Rule("symbols", lambda t: _ratio(count_of(t, r"[#*$%&|<>]+"), n_words(t)) > 0.1),
        Rule("exclamations", lambda t: _ratio(count_of(t, "!+"), n_words(t)) > 0.1),
        Rule("capitals", lambda t: _ratio(count_of(t, r"\p{Lu}+"), count_of(t, r"\p{L}+")) > 0.3),
        Rule("word_length", lambda t: _ratio(F.length(without(t, SPACE)), n_words(t)) > 15),
        Rule("letters", lambda t: _ratio(count_of(t, r"\p{L}+"), F.length(without(t, SPACE))) < 0.5),
        Rule("repeated_lines", lambda t: let(
            F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD)),
            lambda x: _ratio(F.size(x) - F.size(F.array_distinct(x)), F.size(x)) > 0.4)),
        Rule("stutter", lambda t: let(words(t), lambda w: (
            F.when(F.size(w) < 2, False).otherwise(_ratio(stutter(w), F.size(w)) > 0.3)))),
    ]


def base_rule(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 20) | (100 * n_repeat_words > 30 * n_words)


def ordered_rules(docs: DataFrame, rules: list[Rule] | None = None, *, text_col: str = "text",
                  sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules with their cost and selectivity on a sample of about ``sample_rows``
    rows (by a hash of the text), most rejections per second first."""
    rules = rules or standard_rules()
    spark = docs.sparkSession
    text = whole(quoted(text_col)).alias("text")
    rows = docs.select(text).count()
    if not rows:
        return rules
    step = max(1, rows // sample_rows)
    sample = stored(docs.select(text).where(F.pmod(F.xxhash64("text"), F.lit(step)) == 0), "rule-sample")
    measured = []
    spark.range(1).agg(F.max("id")).collect()  # start-up is no rule's cost
    for rule in rules:
        began = time.perf_counter()
        n, hit = sample.agg(F.count(F.lit(1)), F.count_if(rule.rejects(F.col("text")))).first()
        measured.append(replace(rule, cost=time.perf_counter() - began, share=hit / max(n, 1)))
    return sorted(measured, key=lambda r: (-r.share / max(r.cost, 1e-6), r.cost))


def rejected_by(text: Column, rules: list[Rule]) -> Column:
    """Name of the first rule that rejects a text, NULL if none does."""
    body = whole(text)
    chain = F.when(F.lit(False), F.lit(""))
    for rule in rules:
        chain = chain.when(rule.rejects(body), F.lit(rule.name))
    return chain


def quality_report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                   rules: list[Rule] | None = None) -> DataFrame:
    """One row per document: its statistics, base_failed, rejected_by and kept."""
    order = ordered_rules(docs, rules, text_col=text_col)
    rows = with_statistics(docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).alias("text")), "text")
    rows = rows.withColumn("base_failed", base_rule(F.col("n_words"), F.col("n_repeat_words")))
    rows = rows.withColumn("rejected_by", F.when(F.col("base_failed"), F.lit("base"))
                           .otherwise(rejected_by(F.col("text"), order)))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       "base_failed", F.col("rejected_by").isNull().alias("kept"), "rejected_by")


def keep_good(docs: DataFrame, *, text_col: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """The rows of ``docs`` that no rule rejects."""
    order = ordered_rules(docs, rules, text_col=text_col)
    return docs.where(rejected_by(quoted(text_col), order).isNull())
