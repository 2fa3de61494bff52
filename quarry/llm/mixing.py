"""Mixing sources to target weights by weighted fair queueing.

Every source is a flow.  Its documents queue in a shuffled order, once for each
allowed pass over the source; a queued copy has the virtual finish time

    (words of its source up to and including it) / (target of its source)

All copies are ranged by finish time and the order is cut where the total budget
is used up, so at the cut every source has been served in proportion to its
target, to within one document.

Scale: texts are read once for their word counts; all else runs on narrow rows.
The running sums have no group that holds a whole source: a source is split into
hash ranges of a bounded expected size, ranges are summed first, and rows are only
ordered within a range.  The global order is cut the same way: ranges of
finish time are summed, the one that holds the cut is sliced again until it is small,
and only that is sorted.
The result is one threshold per source, so applying a mix to texts needs no
shuffle of texts.

Defined cases: a NULL or empty text has size 0 and is never taken; NULL sources
form one source, ordered last; repeated rows count each time (rows equal in id and
text and tied at the cut go together); an empty table gives an empty mix.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import WORD, quoted, stored, whole, words

#: Sources up to this number have their thresholds broadcast; more are joined by shuffle.
BROADCAST_SOURCES = 100_000
#: Expected rows of one hash range at most, words of a range of finish times that is sorted,
#: and slices of a range that is not.
RANGE_ROWS, RANGE_WORDS, SLICES = 50_000, 1_000_000, 1_024


@dataclass(frozen=True)
class Mix:
    """``sizes``: (doc_id, source, size, order) of every row; ``sources``: one row per
    source with its size, weight, target and the threshold of its queue."""

    sizes: DataFrame
    sources: DataFrame
    few: bool


def _order(id_col: str, text_col: str, seed: int):
    return F.xxhash64(F.lit(seed), quoted(id_col), quoted(text_col))


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """(source, source_size, rank, weight, target).  The target is
    ``min(level * weight, most * size)`` at the one level where the targets use up
    ``share`` of all words; the level is found by aggregations over the sources."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    ranked = per.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("rank") % len(weights) + 1)
    ranked = stored(ranked.withColumn("weight", weight), "mix-sources")
    cap = F.col("source_size") * float(most)
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    budget, level = share * total, 0.0
    while total:
        above = cap <= level * F.col("weight")
        fixed, free = ranked.agg(F.sum(F.when(above, cap).otherwise(0.0)),
                                 F.sum(F.when(above, 0.0).otherwise(F.col("weight")))).first()
        raised = (budget - fixed) / free if free else level
        if raised <= level * (1 + 1e-15):
            break
        level = raised
    return ranked.withColumn("target", F.least(F.lit(level) * F.col("weight"), cap))


def fair_mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, passes: int = 2, seed: int = 20) -> Mix:
    """Queue the documents and cut the global order at the budget.

    ``weights`` go to the sources by code point, repeating; together the targets are
    ``share`` of all words, and none is more than ``passes`` times its source."""
    sizes = stored(docs.select(quoted(id_col).alias("doc_id"), quoted(source_col).cast("string").alias("source"),
                               F.size(words(quoted(text_col))).cast("long").alias("size"),
                               _order(id_col, text_col, seed).alias("order")), "mix-sizes")
    sources = stored(source_targets(sizes, weights, share, passes), "mix-targets")
    rows, total, kinds = sources.agg(F.sum("rows"), F.sum("source_size"), F.count(F.lit(1))).first()
    few = kinds <= BROADCAST_SOURCES
    budget = math.floor(share * (total or 0) + 1e-9)
    # hash ranges within each source, their sums, and the words that queue before each
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(4 * tasks, math.ceil((rows or 0) / RANGE_ROWS))  # a hot source is many tasks at any size
    part = F.least(F.floor((F.col("order") / F.lit(2.0 ** 64) + 0.5) * ranges), F.lit(ranges - 1))
    queued = sizes.where("size > 0").withColumn("part", part)
    before = (F.sum("words").over(Window.partitionBy("source").orderBy("part")) - F.col("words"))
    starts = queued.groupBy("source", "part").agg(F.sum("size").alias("words")).withColumn("before", before)
    starts = (starts.alias("p").join(sources.alias("s"), F.col("p.source").eqNullSafe(F.col("s.source")))
              .select("p.source", "p.part", "p.before", "s.rank", "s.target", "s.source_size"))
    inside = (F.sum("size").over(Window.partitionBy("q.source", "q.part").orderBy("order", "doc_id", "size")
                                 .rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    first = (queued.alias("q").join(starts.alias("s"), F.col("q.source").eqNullSafe(F.col("s.source"))
                                    & (F.col("q.part") == F.col("s.part")))
             .select("rank", "target", "source_size", "order", "size", (F.col("before") + inside).alias("upto")))
    first = stored(first, "mix-queue")
    copies = first.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(passes - 1)))).withColumn(
        "finish", (F.col("upto") + F.col("pass") * F.col("source_size")) / F.col("target"))
    cut = _cut(copies, budget)
    if cut is None:
        taken = copies
    else:
        finish, rank = cut
        taken = copies.where((F.col("finish") < finish) | ((F.col("finish") == finish) & (F.col("rank") <= rank)))
    last = taken.groupBy("rank").agg(F.max(F.struct("pass", "order")).alias("last"))
    sources = sources.join(last, "rank", "left").select(
        "source", "source_size", "rank", "weight", "target", F.col("last.pass").alias("last_pass"),
        F.col("last.order").alias("last_order"))
    return Mix(sizes, stored(sources, "mix-thresholds"), few)


def _cut(copies: DataFrame, budget: int) -> tuple[float, int] | None:
    """(finish, rank) of the last copy within the budget; None if all copies together fit it.
    The range of finish times that holds the cut is sliced again until it is small, so only
    its few rows are ever sorted, however far the finish times reach."""
    total, top = copies.agg(F.sum("size"), F.max("finish")).first()
    if (total or 0) <= budget:
        return None
    low, high, before = 0.0, top, 0
    while True:
        here = copies.where((F.col("finish") >= low) & (F.col("finish") <= high))
        at = F.floor((F.col("finish") - low) / max((high - low) / SLICES, 5e-324))
        sums = here.groupBy(F.least(at, F.lit(SLICES - 1)).alias("at")).agg(
            F.sum("size").alias("words"), F.min("finish").alias("low"), F.max("finish").alias("high"))
        for part in sorted(sums.collect(), key=lambda r: r["at"]):  # at most SLICES rows
            if before + part["words"] > budget:
                break
            before += part["words"]
        narrowed = (part["low"], part["high"]) != (low, high)
        low, high = part["low"], part["high"]
        if part["words"] <= RANGE_WORDS or low == high or not narrowed:
            break
    here = copies.where((F.col("finish") >= low) & (F.col("finish") <= high)).withColumn(
        "run", F.lit(before) + F.sum("size").over(
            Window.orderBy("finish", "rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    found = here.where(F.col("run") <= budget).agg(F.max(F.struct("finish", "rank"))).first()[0]
    # no copy of this range fits: the cut lies just before it
    return (found[0], found[1]) if found else (low, -1)


def copies_taken(rows: DataFrame, mix: Mix) -> DataFrame:
    """``rows`` with ``__q_source, __q_size, __q_order`` joined to their source: adds
    ``__q_copies``, the times the mix takes the row, and the source's columns."""
    sources = mix.sources.select(*[F.col(c).alias(f"__q_s_{c}") for c in mix.sources.columns])
    if mix.few:
        sources = F.broadcast(sources)
    joined = rows.join(sources, F.col("__q_source").eqNullSafe(F.col("__q_s_source")))
    copies = (F.col("__q_s_last_pass")
              + F.when(F.col("__q_order") <= F.col("__q_s_last_order"), 1).otherwise(0))
    return joined.withColumn("__q_copies", F.when(F.col("__q_size") > 0, F.coalesce(copies, F.lit(0))).otherwise(0))


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """One row per document: (doc_id, size, source_size, target, taken, source, copies)."""
    mix = fair_mix(docs, **options)
    rows = mix.sizes.select("doc_id", F.col("source").alias("__q_source"), F.col("size").alias("__q_size"),
                            F.col("order").alias("__q_order"))
    return copies_taken(rows, mix).select(
        "doc_id", F.col("__q_size").alias("size"), F.col("__q_s_source_size").cast("long").alias("source_size"),
        F.col("__q_s_target").alias("target"), (F.col("__q_copies") * F.col("__q_size")).cast("long").alias("taken"),
        F.col("__q_source").alias("source"), F.col("__q_copies").cast("int").alias("copies"))


def mixed_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                    source_col: str = "source", seed: int = 20, **options) -> DataFrame:
    """The mixed corpus: the rows of ``docs``, each as often as the mix takes it."""
    mix = fair_mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, seed=seed, **options)
    rows = docs.withColumns({"__q_source": quoted(source_col).cast("string"),
                             "__q_size": whole(quoted(text_col)).rlike(WORD).cast("int"),
                             "__q_order": _order(id_col, text_col, seed)})
    rows = copies_taken(rows, mix).where("__q_copies > 0")
    rows = rows.withColumn("__q_pass", F.explode(F.sequence(F.lit(1), F.col("__q_copies"))))
    return rows.select(*[quoted(c) for c in docs.columns])
