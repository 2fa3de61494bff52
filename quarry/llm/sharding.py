"""Sharding by a k-d tree over document metadata.

A node holds a box of the metadata space and the number of shards it must yield.
It is split along its widest dimension (extents relative to the whole corpus) at
the weighted median, or the weighted quantile where it holds an odd number of
shards, until each leaf is one shard of about the target bytes.

The quantiles are exact weighted selections done as distributed histograms: per
pass, one aggregation sums the weights of 256 bins for all nodes of a level, and
the bin that holds the quantile is refined.  The driver sees one row per node; once the
bins of all nodes together hold ``FEW`` keys at most, it takes these and refines them itself.
The tree is a short list of splits, so placing a row (a text included) needs no
shuffle: it is a chain of joins with broadcast tables of at most ``MAX_SHARDS`` rows.

Metadata come from the text itself, and ties along a dimension are ordered by the
text's hash, so equal texts stay in one shard.  Only a group of equal texts that
alone outweighs a twentieth of a shard is dealt out by doc_id: it could not be
balanced otherwise.

Defined cases: a NULL text is an empty one (size 1); repeated rows count each time;
fewer distinct rows than shards leave shards empty; an empty table stays empty.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import quoted, stored, whole

MAX_SHARDS = 65_536
#: Bins of one histogram pass, and the share of a shard that may lie off the exact quantile.
BINS, SLACK = 256, 0.002
#: Keys in the bins of all nodes that the driver refines without further passes.
FEW = 4_096
#: Bits of a sort key: the dimension's value in steps of the corpus extent, then the tie.
VALUE_BITS, TIE_BITS = 20, 42


@dataclass(frozen=True)
class Split:
    node: int
    dim: int
    cut: int  # rows with a key of at least ``cut`` go right
    left: int  # node numbers of the children
    right: int


@dataclass(frozen=True)
class Tree:
    """Splits by level, the corpus extent of each dimension and the first shard per leaf."""

    levels: list[list[Split]]
    extents: list[tuple[float, float]]
    leaves: dict[int, int]
    hot: list[int]


def text_metadata(text: Column) -> list[Column]:
    """Dimensions: log bytes, share of multi-byte text, log lines, log mean word length."""
    body = whole(text)
    size = F.octet_length(body)
    lines = size - F.octet_length(F.replace(body, F.lit("\n"), F.lit("")))
    blanks = size - F.octet_length(F.replace(body, F.lit(" "), F.lit("")))
    return [F.log1p(size.cast("double")), F.when(size > 0, 1 - F.length(body) / size).otherwise(0.0),
            F.log1p(lines.cast("double")), F.log1p(size / (blanks + lines + 1))]


def _measured(docs: DataFrame, id_col: str, text_col: str) -> dict[str, Column]:
    text = quoted(text_col)
    return {"__q_size": (F.octet_length(whole(text)) + 1).cast("long"), "__q_text": F.xxhash64(whole(text)),
            "__q_dims": F.array(*text_metadata(text)), "__q_id": F.xxhash64(quoted(id_col))}


def _keys(rows: DataFrame, extents: list[tuple[float, float]], hot: list[int]) -> DataFrame:
    """Adds ``__q_keys``: per dimension one long that sorts by value, then by text."""
    tie = F.when(F.col("__q_text").isin(hot), F.xxhash64("__q_text", "__q_id")).otherwise(F.col("__q_text")) \
        if hot else F.col("__q_text")
    tie = F.shiftrightunsigned(tie, 64 - TIE_BITS)
    top = 2 ** VALUE_BITS - 1
    keys = [F.shiftleft(F.floor((F.element_at("__q_dims", k + 1) - lo) * (top / (hi - lo) if hi > lo else 0.0))
                        .cast("long"), TIE_BITS).bitwiseOR(tie) for k, (lo, hi) in enumerate(extents)]
    return rows.withColumn("__q_keys", F.array(*keys))


def grow_tree(rows: DataFrame, n_shards: int | None = None, target_bytes: int | None = None) -> Tree:
    """The tree over ``rows`` (``__q_size, __q_text, __q_dims, __q_id``)."""
    n_dims = 4
    ends = rows.agg(F.sum("__q_size"), *[f(F.element_at("__q_dims", k + 1)) for k in range(n_dims)
                                         for f in (F.min, F.max)]).first()
    total = ends[0] or 0
    shards = n_shards or max(1, math.ceil(total / (target_bytes or 1)))
    if shards > MAX_SHARDS:
        raise ValueError(f"{shards} shards; at most {MAX_SHARDS} are supported")
    extents = [(ends[1 + 2 * k], ends[2 + 2 * k]) for k in range(n_dims)] if total else [(0.0, 0.0)] * n_dims
    heavy = total / shards / 20
    hot = [r[0] for r in rows.groupBy("__q_text").agg(F.sum("__q_size").alias("w"), F.count(F.lit(1)).alias("n"))
           .where((F.col("w") > heavy) & (F.col("n") > 1)).select("__q_text").collect()]  # at most 20 a shard
    rows = stored(_keys(rows, extents, hot).select("__q_size", "__q_keys"), "kd-keys")
    nodes, levels, leaves, free = {0: (shards, 0)}, [], {}, 1  # node -> (shards, first shard)
    while True:
        leaves.update({n: first for n, (k, first) in nodes.items() if k == 1})
        split = {n: v for n, v in nodes.items() if v[0] > 1}
        if not split:
            return Tree(levels, extents, leaves, hot)
        here = _descend(rows, levels)
        dims, spans, weights = _widest(here, split, n_dims)
        cuts = _quantiles(here, {n: (dims[n], *spans[n], weights[n], split[n][0]) for n in split if n in dims})
        level, nodes = [], {}
        for n, (k, first) in sorted(split.items()):
            level.append(Split(n, dims.get(n, 0), cuts.get(n, 0), free, free + 1))
            nodes |= {free: (k // 2, first), free + 1: (k - k // 2, first + k // 2)}
            free += 2
        levels.append(level)


def _descend(rows: DataFrame, levels: list[list[Split]]) -> DataFrame:
    """``rows`` with ``__q_node`` after the given levels of the tree."""
    # node 0 for all; a literal would turn the first equi-join into a nested loop
    rows = rows.withColumn("__q_node", (F.col("__q_size") < 0).cast("int"))
    for level in levels:
        splits = rows.sparkSession.createDataFrame(
            [(s.node, s.dim, s.cut, s.left, s.right) for s in level],
            "__q_at int, __q_dim int, __q_cut long, __q_left int, __q_right int")
        rows = rows.join(F.broadcast(splits), F.col("__q_node") == F.col("__q_at"), "left")
        rows = rows.withColumn("__q_node", F.when(F.col("__q_at").isNull(), F.col("__q_node")).otherwise(
            F.when(F.element_at("__q_keys", F.col("__q_dim") + 1) >= F.col("__q_cut"), F.col("__q_right"))
            .otherwise(F.col("__q_left")))).drop("__q_at", "__q_dim", "__q_cut", "__q_left", "__q_right")
    return rows


def _widest(here: DataFrame, split: dict, n_dims: int):
    ends = here.groupBy("__q_node").agg(
        F.sum("__q_size").alias("w"), *[f(F.element_at("__q_keys", k + 1)).alias(f"{f.__name__}{k}")
                                        for k in range(n_dims) for f in (F.min, F.max)]).collect()
    dims, spans, weights = {}, {}, {}
    for r in ends:
        if (n := r["__q_node"]) in split:
            width = [(r[f"max{k}"] >> TIE_BITS) - (r[f"min{k}"] >> TIE_BITS) for k in range(n_dims)]
            dims[n] = k = max(range(n_dims), key=lambda i: (width[i], -i))
            spans[n], weights[n] = (r[f"min{k}"], r[f"max{k}"] + 1), r["w"]
    return dims, spans, weights


@dataclass(frozen=True)
class _Interval:
    """Keys ``low`` to ``high`` of a dimension that hold a node's cut; rows below weigh ``below``."""

    dim: int
    low: int
    high: int
    below: int
    goal: float
    slack: float

    @property
    def step(self) -> int:
        return -(-(self.high - self.low) // BINS)

    @property
    def want(self) -> float:
        return float(self.goal - self.below)

    def narrowed(self, b: int, w: int, upto: int) -> _Interval | int:
        """What bin ``b`` of weight ``w`` leaves, all bins up to it weighing ``upto``; or the cut."""
        left = self.low + b * self.step
        right = min(self.high, left + self.step)
        under, over = self.below + upto - w, self.below + upto  # weights below either end of the bin
        if min(self.goal - under, over - self.goal) <= self.slack or right - left == 1:
            return left if self.goal - under <= over - self.goal else right
        return replace(self, low=left, high=right, below=under)


def _quantiles(here: DataFrame, nodes: dict[int, tuple[int, int, int, int, int]]) -> dict[int, int]:
    """Cut keys.  ``nodes``: node -> (dim, low, high, weight, shards); the rows below the
    cut weigh ``shards // 2 / shards`` of the node, to within SLACK of a shard."""
    spark, cuts = here.sparkSession, {}
    open_ = {n: _Interval(d, lo, hi, 0, w * (k // 2) / k, SLACK * w / k) for n, (d, lo, hi, w, k) in nodes.items()}
    while open_:
        table = spark.createDataFrame(
            [(n, i.dim, i.low, i.high, i.step, i.want) for n, i in open_.items()],
            "n int, d int, lo long, hi long, step long, want double")
        rows = here.join(F.broadcast(table), F.col("__q_node") == F.col("n")).withColumn(
            "k", F.element_at("__q_keys", F.col("d") + 1)).where("k >= lo and k < hi")
        bins = rows.groupBy("n", "want", F.expr("(k - lo) div step").alias("b")).agg(
            F.sum("__q_size").alias("w"), F.when(F.min("k") == F.max("k"), 1).otherwise(F.count("k")).alias("keys"))
        run = bins.withColumn("upto", F.sum("w").over(Window.partitionBy("n").orderBy("b")))
        hits = run.where("upto >= want").groupBy("n").agg(F.min(F.struct("b", "w", "upto", "keys")).alias("hit")).collect()
        for n in set(open_) - {r["n"] for r in hits}:  # the goal is all of the interval, but for rounding
            cuts[n] = open_.pop(n).high
        keys = 0
        for r in hits:
            b, w, upto, held = r["hit"]
            left = open_.pop(r["n"]).narrowed(b, w, upto)
            if isinstance(left, int):
                cuts[r["n"]] = left
            else:
                open_[r["n"]] = left
                keys += held
        if open_ and keys <= FEW:
            return cuts | _finished(here, open_)
    return cuts


def _finished(here: DataFrame, open_: dict[int, _Interval]) -> dict[int, int]:
    """The cuts that further passes would find, from the few keys of the open intervals."""
    table = here.sparkSession.createDataFrame(
        [(n, i.dim, i.low, i.high) for n, i in open_.items()], "n int, d int, lo long, hi long")
    rows = here.join(F.broadcast(table), F.col("__q_node") == F.col("n")).withColumn(
        "k", F.element_at("__q_keys", F.col("d") + 1)).where("k >= lo and k < hi")
    weights: dict[int, list[tuple[int, int]]] = {n: [] for n in open_}
    for n, k, w in rows.groupBy("n", "k").agg(F.sum("__q_size")).collect():
        weights[n].append((k, w))
    cuts = {}
    for n, left in open_.items():
        inside = sorted(weights[n])
        while not isinstance(left, int):
            inside = [(k, w) for k, w in inside if left.low <= k < left.high]
            bins: dict[int, int] = {}
            for k, w in inside:
                b = (k - left.low) // left.step
                bins[b] = bins.get(b, 0) + w
            hit = next((x for x in zip(bins, bins.values(), accumulate(bins.values())) if x[2] >= left.want), None)
            left = left.narrowed(*hit) if hit else left.high
        cuts[n] = left
    return cuts


def _placed(rows: DataFrame, tree: Tree) -> DataFrame:
    """Adds ``__q_shard``."""
    rows = _descend(_keys(rows, tree.extents, tree.hot), tree.levels)
    leaves = rows.sparkSession.createDataFrame(sorted(tree.leaves.items()), "__q_leaf int, __q_shard int")
    return rows.join(F.broadcast(leaves), F.col("__q_node") == F.col("__q_leaf")).drop("__q_leaf", "__q_node")


def _numbered(rows: DataFrame) -> DataFrame:
    """Adds ``__q_slot``: row numbers without gaps within ``__q_shard``.  A group to be
    ordered is what one input partition (``__q_part``) sends to one shard."""
    sums = rows.groupBy("__q_shard", "__q_part").agg(F.count(F.lit(1)).alias("__q_n"))
    before = F.sum("__q_n").over(Window.partitionBy("__q_shard").orderBy("__q_part")) - F.col("__q_n")
    starts = sums.select(F.col("__q_shard").alias("__q_s"), F.col("__q_part").alias("__q_p"),
                         before.alias("__q_before"))
    local = F.row_number().over(Window.partitionBy("__q_shard", "__q_part").orderBy("__q_id", "__q_text", "__q_row"))
    return (rows.withColumn("__q_local", local)
            .join(starts, (F.col("__q_shard") == F.col("__q_s")) & (F.col("__q_part") == F.col("__q_p")))
            .withColumn("__q_slot", (F.col("__q_before") + F.col("__q_local") - 1).cast("long")))


def shard_report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n_shards: int | None = 8,
                 target_bytes: int | None = None) -> DataFrame:
    """One row per document: (doc_id, size, text_crc32, shard, slot)."""
    rows = docs.select(quoted(id_col).alias("doc_id"),
                       F.crc32(whole(quoted(text_col)).cast("binary")).alias("text_crc32"),
                       *[c.alias(k) for k, c in _measured(docs, id_col, text_col).items()],
                       F.spark_partition_id().alias("__q_part"), F.monotonically_increasing_id().alias("__q_row"))
    rows = stored(rows, "kd-rows")
    tree = grow_tree(rows, n_shards, target_bytes)
    return _numbered(_placed(rows, tree)).select(
        "doc_id", F.col("__q_size").alias("size"), "text_crc32", F.col("__q_shard").alias("shard"),
        F.col("__q_slot").alias("slot"))


def sharded_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                      n_shards: int | None = 8, target_bytes: int | None = None) -> DataFrame:
    """The rows of ``docs`` with ``shard`` and ``slot`` (replacing columns so named),
    laid out by shard: the only shuffle of texts brings a shard's rows together."""
    measured = _measured(docs, id_col, text_col)
    tree = grow_tree(stored(docs.select(*[c.alias(k) for k, c in measured.items()]), "kd-rows"),
                     n_shards, target_bytes)
    kept = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    rows = docs.select(*[quoted(c) for c in kept], *[c.alias(k) for k, c in measured.items()],
                       F.spark_partition_id().alias("__q_part"), F.monotonically_increasing_id().alias("__q_row"))
    rows = _placed(rows, tree)
    return _numbered(rows).select(*[quoted(c) for c in kept], F.col("__q_shard").alias("shard"),
                                  F.col("__q_slot").alias("slot"))
