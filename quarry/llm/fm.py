"""A factorization machine over hashed binary features, and its Spark plumbing.

    score = sigmoid(w0 + sum w_i + sum_{i<j} <v_i, v_j>)

where i, j run over the features a row has.  The pair sum costs time linear in the
features: half of ``sum_f (sum_i v_if)^2 - sum_i v_if^2``.

Fitting.  Per-class document counts of every hashed feature come from one
distributed aggregation over all labelled training rows.  Two kinds of buckets become the
model's features: those of ``MIN_DF`` rows and more that separate the classes (chi-square
at least ``LEAST_CHI2``), and all that ``FREQUENT`` of the rows hold, whatever they tell
alone - a term that is as common in both classes may matter beside another.  Of each kind
there are at most as many as a fifth of the labelled rows (``FEATURES`` at least), the best
first; so their number grows with the labels.  The machine is then fitted with mini-batch Adam on the driver on
a bounded sample of ``SAMPLE_ROWS`` labelled rows (documented parameters; rows are
taken by a hash of their id, a tenth of them choose the number of epochs).

Scoring is one pass over all rows: features are hashed in the JVM, and Arrow batches
of bucket numbers are scored with numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import stored

#: 2^20 hash buckets; features of each kind for few labels; least chi-square and rows of a
#: feature that tells by itself; share of the rows that makes a feature frequent.
BUCKETS, FEATURES, LEAST_CHI2, MIN_DF, FREQUENT = 1 << 20, 4_096, 6.6, 3, 0.1
#: Labelled rows that a fit reads: for the sample, and for the class counts (these are
#: broadcast, 12 bytes each; more labels are thinned by a hash of the id).
SAMPLE_ROWS, LABEL_ROWS = 20_000, 1_000_000
FACTORS, EPOCHS, BATCH, RATE, DECAY = 8, 25, 256, 0.02, 2e-4


def buckets(features: Column) -> Column:
    """Hash buckets of an array of feature strings, each once."""
    return F.array_distinct(F.transform(features, lambda x: F.pmod(F.xxhash64(x), F.lit(BUCKETS)).cast("int")))


@dataclass
class Machine:
    """``place``: bucket -> feature number or -1."""

    place: np.ndarray
    w0: float
    w: np.ndarray
    v: np.ndarray

    def margin(self, feature: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
        """``feature`` numbers of the rows numbered by ``row``."""
        out = self.w0 + np.bincount(row, self.w[feature], rows)
        for f in range(self.v.shape[1]):
            x = self.v[feature, f]
            out += 0.5 * (np.bincount(row, x, rows) ** 2 - np.bincount(row, x * x, rows))
        return out

    def score(self, lists: pa.ListArray) -> np.ndarray:
        feature, row = placed(self.place, lists)
        return 1.0 / (1.0 + np.exp(-np.clip(self.margin(feature, row, len(lists)), -35, 35)))


def placed(place: np.ndarray, lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(feature numbers, row numbers) of the model's features in lists of buckets."""
    offsets = np.asarray(lists.offsets).astype(np.int64)
    feature = place[np.asarray(lists.values)[offsets[0]:offsets[-1]]]
    row = np.repeat(np.arange(len(lists)), np.diff(offsets))
    known = feature >= 0
    return feature[known], row[known]


def fit_machine(place: np.ndarray, feature: np.ndarray, row: np.ndarray, y: np.ndarray, seed: int = 7) -> Machine:
    """Mini-batch Adam on the logistic loss; of the epochs, the one best on held-back rows."""
    rng = np.random.default_rng(seed)
    m = int(place.max()) + 1 if len(place) else 0
    rate = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
    model = Machine(place, float(np.log(rate / (1 - rate))), np.zeros(m), rng.normal(0, 0.02, (m, FACTORS)))
    if not len(y) or not m:
        return model
    by_row = np.argsort(row, kind="stable")
    feature, starts = feature[by_row], np.r_[0, np.cumsum(np.bincount(row, minlength=len(y)))]
    shuffled = rng.permutation(len(y))
    test, train = shuffled[:len(y) // 10], shuffled[len(y) // 10:]

    def of(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = starts[rows + 1] - starts[rows]
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return feature[np.repeat(starts[rows], n) + inner], np.repeat(np.arange(len(rows)), n)

    theta = np.concatenate([model.v, model.w[:, None]], axis=1)
    first, second, step, best = np.zeros_like(theta), np.zeros_like(theta), 0, (np.inf, None)
    test_x = of(test)
    for _ in range(EPOCHS):
        for rows in np.array_split(rng.permutation(train), max(1, len(train) // BATCH)):
            x, r = of(rows)
            model.v, model.w = theta[:, :FACTORS], theta[:, FACTORS]
            error = 1 / (1 + np.exp(-np.clip(model.margin(x, r, len(rows)), -35, 35))) - y[rows]
            grad = DECAY * theta
            e = error[r] / len(rows)
            for f in range(FACTORS):
                vf = theta[x, f]
                sums = np.bincount(r, vf, len(rows))
                grad[:, f] += np.bincount(x, e * (sums[r] - vf), m)
            grad[:, FACTORS] += np.bincount(x, e, m)
            step += 1
            first += 0.1 * (grad - first)
            second += 0.001 * (grad * grad - second)
            theta = theta - RATE * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
            model.w0 -= RATE * float(error.mean())
        model.v, model.w = theta[:, :FACTORS], theta[:, FACTORS]
        if len(test):
            z = np.clip(model.margin(*test_x, len(test)), -35, 35)
            loss = float(np.mean(np.log1p(np.exp(-z)) + (1 - y[test]) * z))
            if loss < best[0]:
                best = (loss, (theta.copy(), model.w0))
    if best[1] is not None:
        theta, model.w0 = best[1]
        model.v, model.w = theta[:, :FACTORS], theta[:, FACTORS]
    return model


def labelled(rows: DataFrame, labels: DataFrame, sample_rows: int) -> DataFrame:
    """``rows`` (id, ...) with ``y`` of ``labels`` (id, y): at most about ``sample_rows`` labels."""
    labels = labels.where(F.col("id").isNotNull() & F.col("y").isNotNull()).groupBy("id").agg(
        F.max("y").cast("int").alias("y"))
    n = labels.count()
    if n > sample_rows:
        labels = labels.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < F.lit(int(1_000_000 * sample_rows / n)))
    return rows.join(F.broadcast(labels), "id")


def fit(train: DataFrame, labels: DataFrame, x: Column, *, features: int = FEATURES,
        sample_rows: int = SAMPLE_ROWS) -> Machine:
    """``train``: (id, text), training rows only; ``labels``: (id, y); ``x``: the hash buckets
    of ``text``, computed for labelled rows only."""
    rows = stored(labelled(train, labels, LABEL_ROWS).select("id", "y", x.alias("x")), "fm-train")
    n, n1 = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    n0 = n - n1
    place = np.full(BUCKETS, -1, np.int32)
    empty = np.empty(0, np.int64)
    if not n1 or not n0:
        return fit_machine(place, empty, empty, np.full(n, 1.0 if n1 else 0.0) if n else np.empty(0))
    counts = rows.select(F.explode("x").alias("b"), "y").groupBy("b").agg(
        F.count(F.lit(1)).alias("df"), F.sum("y").alias("df1"))
    # chi-square of the 2 x 2 table (class, has the feature)
    a, c = F.col("df1").cast("double"), (F.col("df") - F.col("df1")).cast("double")
    chi2 = n * F.pow(a * (n0 - c) - c * (n1 - a), 2) / (F.lit(float(n1)) * n0 * (a + c) * F.greatest(n - a - c, F.lit(1.0)))
    counts = stored(counts.withColumn("chi2", chi2), "fm-counts")
    most = max(features, n // 5)
    telling = counts.where((F.col("chi2") >= LEAST_CHI2) & (F.col("df") >= MIN_DF)).orderBy(F.desc("chi2"), "b").limit(most)
    frequent = counts.where(F.col("df") >= FREQUENT * n).orderBy(F.desc("df"), "b").limit(most)
    chosen = telling.select("b").unionByName(frequent.select("b")).distinct().collect()  # at most 2 x most numbers
    for k, b in enumerate(sorted(r["b"] for r in chosen)):
        place[b] = k
    if n > sample_rows:
        rows = rows.where(F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(1_000_000)) < F.lit(int(1_000_000 * sample_rows / n)))
    sample = rows.mapInArrow(_placer(place), "id string, y int, x array<int>").toArrow().sort_by("id")
    lists = sample.column("x").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    offsets = np.asarray(lists.offsets).astype(np.int64)
    feature = np.asarray(lists.values)[offsets[0]:offsets[-1]].astype(np.int64)
    row = np.repeat(np.arange(len(lists)), np.diff(offsets))
    return fit_machine(place, feature, row, np.asarray(sample.column("y")).astype(float))


def _placer(place: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            feature, row = placed(place, batch.column("x"))
            offsets = np.r_[0, np.cumsum(np.bincount(row, minlength=batch.num_rows))].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(feature.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("id").cast(pa.string()), batch.column("y"), lists],
                                             ["id", "y", "x"])
    return run


def scored(rows: DataFrame, model: Machine, x: str = "x", score: str = "score") -> DataFrame:
    """``rows`` with ``x`` (hash buckets) replaced by the score."""
    others = [f for f in rows.schema.fields if f.name != x]
    at, keep = rows.columns.index(x), [k for k, c in enumerate(rows.columns) if c != x]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keep], pa.array(model.score(batch.column(at)))],
                                             [*[f.name for f in others], score])

    return rows.mapInArrow(run, T.StructType([*others, T.StructField(score, T.DoubleType())]))
