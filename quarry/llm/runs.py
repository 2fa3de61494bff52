"""Periodic runs of words, found through Lyndon roots.

A run is a stretch of consecutive words with smallest period q, at least ``min_words`` long
and at least ``min_periods`` times its period, that no neighbouring word extends.  Every run
holds a Lyndon root: a word that is the longest Lyndon word at its place, in the order of
the alphabet or in the reverse order.

1. **Grouping** (phase one of Baier's suffix sorter): suffixes start in groups by their
   first word.  Groups are taken from the highest down; each member points to the nearest
   place before it that is not yet taken, and a place that l members point to moves to a new
   group just above its own, whose context is longer by l contexts of the group taken.  When
   a group is taken, its context length is the longest Lyndon word at its members: the
   Lyndon array, without a suffix array.  Done once for each of the two orders.
2. **Extension**: each root (i, i + q) is extended to both sides by longest common
   extensions, from names of all blocks of 2^k words (equal names, equal blocks; names come
   from sorting, so there are no collisions).  Long enough extensions are runs; roots of one
   run agree after extension.

Reduction that loses no run: with W = ``window(min_words, min_periods)``, every stretch of W
words of a run occurs a second time in the text, one period away.  So only maximal stretches
of places whose W words occur twice in their text are searched; the stretches of a batch of
texts are joined with a word of its own between any two, and a run cannot hold a word that
occurs once.

Scale: no shuffle; a task holds the words of at most ``SLICE`` characters of texts (or one
longer text).  A text is one row; its work is n log n in its words.

Defined cases: NULL and empty texts have no words and no runs; fewer words than
``min_words`` have no runs; repeated rows and ids get equal results; a NULL id stays NULL;
an empty table gives no rows; other columns of the table are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import quoted, whole

MIN_WORDS, MIN_PERIODS, SLICE = 24, 3, 1_000_000
RUNS = "array<struct<start:long,length:long,period:long>>"


def lyndon_array(x: list[int]) -> list[int]:
    """Length of the longest Lyndon word at each place, by grouping."""
    n = len(x)
    rank = {c: k for k, c in enumerate(sorted(set(x)))}
    group = [rank[c] for c in x]
    members: list[list[int]] = [[] for _ in rank]
    for i, g in enumerate(group):
        members[g].append(i)
    width, below, above = [1] * len(rank), list(range(-1, len(rank) - 1)), list(range(1, len(rank) + 1))
    # free[i + 1] leads to the nearest place not after i that is not yet taken (0: none)
    free = list(range(n + 1))
    lyndon = [0] * n
    g = len(rank) - 1
    while g >= 0:
        here, w = [i for i in members[g] if group[i] == g], width[g]
        for i in here:
            lyndon[i] = w
            free[i + 1] = i
        pointed: dict[int, int] = {}
        for i in here:
            j = i
            while free[j] != j:  # halve the path on the way
                free[j] = j = free[free[j]]
            if j:
                pointed[j - 1] = pointed.get(j - 1, 0) + 1
        made: dict[tuple[int, int], int] = {}
        # places with most pointers first: later groups go in between, so these end highest
        for p in sorted(pointed, key=pointed.__getitem__, reverse=True):
            times, old = pointed[p], group[p]
            new = made.get((times, old))
            if new is None:
                new = made[times, old] = len(members)
                members.append([])
                width.append(width[old] + times * w)
                below.append(old)
                above.append(above[old])
                below[above[old]] = new
                above[old] = new
            group[p] = new
            members[new].append(p)
        g = below[g]
    return lyndon


def block_names(x: np.ndarray, longest: int) -> list[np.ndarray]:
    """``names[k][i]``: the name of the block of 2^k words at i, up to ``longest`` words;
    equal names of one level are equal blocks."""
    names, k = [x], 1
    while 2 * k <= longest:
        last = names[-1]
        pairs = last[:-k] * np.int64(len(x) + 1) + last[k:]
        names.append(np.unique(pairs, return_inverse=True)[1].astype(np.int64))
        k *= 2
    return names


def extensions(names: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far the words at and after a and b agree, and those before a and b (a < b)."""
    after, before = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
    for k in range(len(names) - 1, -1, -1):
        name, step = names[k], 1 << k
        for _ in range(2 if k == len(names) - 1 else 1):  # up to two blocks of the longest kind
            inside = b + after < len(name)
            same = inside & (name[np.where(inside, a + after, 0)] == name[np.where(inside, b + after, 0)])
            after += step * same
            inside = a - before >= step
            same = inside & (name[np.where(inside, a - before - step, 0)] == name[np.where(inside, b - before - step, 0)])
            before += step * same
    return after, before


def find_runs(x: np.ndarray, min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS, longest: int | None = None) -> np.ndarray:
    """Rows (start, length, period) of all runs of a sequence of small integers, sorted by
    start and period.  No run is longer than ``longest`` words (default: all of them)."""
    n = len(x)
    if n < max(min_words, 2):
        return np.zeros((0, 3), np.int64)
    x = np.unique(x, return_inverse=True)[1].astype(np.int64)
    names = block_names(x, min(longest or n, n))
    found, place = [], np.arange(n)
    for order in (x, -x):
        period = np.array(lyndon_array(order.tolist()), np.int64)
        # a run of two periods and more holds a copy of its root before or after it
        a = place[(place + period < n)]
        a = a[(x[a] == x[a + period[a]]) | ((a > 0) & (x[a - 1] == x[a + period[a] - 1]))]
        q = period[a]
        after, before = extensions(names, a, a + q)
        length = before + q + after
        good = (length >= min_words) & (length >= min_periods * q)
        found.append(np.column_stack([a - before, length, q])[good])
    runs = np.unique(np.concatenate(found), axis=0)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def window(min_words: int, min_periods: int) -> int:
    """The longest W such that every W consecutive words of a run stand a second time in it:
    a run of L words and period q holds them if L >= 2 q + W - 1."""
    return max(1, min(max(min_words, min_periods * q) - 2 * q + 1 for q in range(1, min_words + 2)))


def repeated_stretches(hashes: np.ndarray, doc: np.ndarray, w: int) -> np.ndarray:
    """Rows (first, end) of the maximal stretches, within one text, of places whose w words
    (by 64-bit hash) occur more than once in the text."""
    m = len(hashes) - w + 1
    if m <= 1:
        return np.zeros((0, 2), np.int64)
    mixed = np.zeros(m, np.uint64)
    for k in range(w):
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        mixed += hashes[k:k + m]
        mixed ^= mixed >> np.uint64(31)
    mixed += doc[:m].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    inside = np.flatnonzero(doc[:m] == doc[w - 1:])
    values = mixed[inside]
    order = np.argsort(values, kind="stable")
    ranked = values[order]
    equal = ranked[1:] == ranked[:-1]
    twice = np.zeros(len(values), bool)
    twice[order[1:][equal]] = True
    twice[order[:-1][equal]] = True
    starts = inside[twice]
    if not len(starts):
        return np.zeros((0, 2), np.int64)
    cut = np.flatnonzero((np.diff(starts) > 1) | (np.diff(doc[starts]) != 0)) + 1
    return np.column_stack([starts[np.append(0, cut)], starts[np.append(cut - 1, len(starts) - 1)] + w])


def runs_of(texts: list[list[bytes]], min_words: int, min_periods: int) -> dict[int, np.ndarray]:
    """Runs of the texts (lists of words) that have any."""
    lengths = np.array([len(t) for t in texts], np.int64)
    doc, base = np.repeat(np.arange(len(texts)), lengths), np.cumsum(lengths) - lengths
    flat = [w for t in texts for w in t]
    hashes = np.fromiter(map(hash, flat), np.int64, len(flat)).view(np.uint64)
    parts = repeated_stretches(hashes, doc, window(min_words, min_periods))
    parts = parts[parts[:, 1] - parts[:, 0] >= min_words]
    if not len(parts):
        return {}
    number: dict[bytes, int] = {}
    joined, origin = [], []
    for k, (a, b) in enumerate(parts.tolist()):
        joined += [number.setdefault(w, len(number)) for w in flat[a:b]]
        joined.append(-1 - k)  # a word of its own ends the stretch
        origin.append(np.arange(a, b + 1))
    rows = find_runs(np.array(joined, np.int64), min_words, min_periods, int((parts[:, 1] - parts[:, 0]).max()))
    place = np.concatenate(origin)[rows[:, 0]]
    owner = doc[place]
    rows = np.column_stack([place - base[owner], rows[:, 1:]])
    order = np.lexsort((rows[:, 2], rows[:, 0], owner))
    rows, owner = rows[order], owner[order]
    cuts = np.flatnonzero(np.diff(owner)) + 1
    return {int(o[0]): r for o, r in zip(np.split(owner, cuts), np.split(rows, cuts)) if len(r)}


def collapsed(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words that no run holds after its first period."""
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return [w for w, k in zip(words, (np.cumsum(change[:-1]) == 0).tolist()) if k]


def _finder(min_words: int, min_periods: int):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                texts, size = [], 0
                while at + len(texts) < batch.num_rows and size < SLICE:
                    raw = batch.column(1)[at + len(texts)].as_py()
                    size += len(raw)
                    texts.append(raw.split())  # bytes: white space is \x20 and \x09-\x0D
                found = runs_of(texts, min_words, min_periods)
                none = np.zeros((0, 3), np.int64)
                rows = [found.get(k, none) for k in range(len(texts))]
                kept = [b" ".join(collapsed(t, r) if len(r) else t) for t, r in zip(texts, rows)]
                ends = np.append(0, np.cumsum([len(r) for r in rows])).astype(np.int32)
                flat = np.concatenate(rows)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(
                    [pa.array(np.ascontiguousarray(flat[:, c])) for c in range(3)], fields=list(kind.value_type)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), pa.array([len(t) for t in texts], pa.int64()), lists,
                     pa.array(kept, pa.binary()).cast(pa.string())], ["id", "n_words", "runs", "collapsed"])
                at += len(texts)
    return run


def periodic_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS,
                  min_periods: int = MIN_PERIODS) -> DataFrame:
    """(id, n_words, runs, collapsed): the runs of every whole text, sorted by start and
    period, and its words, one space between, without those that a run holds after its
    first period."""
    if min_periods < 2 or min_words < 2:
        raise ValueError("a run has two periods and two words at least")
    rows = docs.select(quoted(id_col).alias("id"), whole(quoted(text_col)).cast("binary").alias("text"))
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType)]
                          + T._parse_datatype_string(f"n_words long, runs {RUNS}, collapsed string").fields)
    return rows.mapInArrow(_finder(min_words, min_periods), schema).withColumnRenamed("id", id_col)


def strongest(runs: Column) -> Column:
    """The run with the greatest exact length / period (ties: smallest start, then period);
    NULL without a run.  Quotients are compared by products."""
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")

    def better(best: Column, r: Column) -> Column:
        mine, other = r["length"] * best["period"], best["length"] * r["period"]
        first = F.struct(r["start"], r["period"]) < F.struct(best["start"], best["period"])
        return F.when(best.isNull() | (mine > other) | ((mine == other) & first), r).otherwise(best)

    return F.aggregate(runs, none, better)


def listed(runs: Column) -> Column:
    """All runs as lines ``start,length,period``."""
    return F.array_join(F.transform(runs, lambda r: F.concat(
        r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
