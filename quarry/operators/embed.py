"""Text vectors from word co-occurrence counts under a random projection.

A word's vector is the row of its co-occurrence counts (words at most ``window`` places
away), projected by a fixed matrix of random signs: the sum, over all its neighbours, of the
neighbour's sign vector.  A sign vector is a hash of the word and the seed, so no matrix is
stored and reruns agree.  A text's vector is the mean of its words' unit vectors, each word
weighted by its inverse document frequency, scaled to length one.

1. Tasks cut texts into words (the lexemes of the text search), add up neighbours' signs per
   word over many texts, and emit one row per word and flush (a word of every text has no more
   rows than there are flushes); their sums are ``(word, n, df, vector)``.  Sums of signs are
   whole numbers, stored in as many bytes as the word's count asks for: one for most words.
2. Up to ``FREQUENT`` words of the highest document frequency are broadcast (a bounded table)
   and cover most places of any text inside the scan; each of the other words of a text
   becomes a row that meets its stored vector in a join; the task that gets all rows of a text
   weighs and adds them.

Nothing of the vocabulary's size is held by the driver or a task but flushes of bounded size.

Defined cases: NULL and empty texts, and texts of stop words only, have a NULL vector;
words that the model does not know count nothing; repeated rows get equal vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators.text_search import kept_tokens
from quarry.session import scratch_path

DIMENSIONS, WINDOW, FREQUENT = 64, 2, 20_000
FLUSH, SLICE = 100_000, 100_000
#: Whole numbers that a stored vector may consist of, by their width in bytes.
WHOLE = {1: np.dtype("i1"), 2: np.dtype("<i2"), 4: np.dtype("<i4")}
WORDS = "word string, n long, df long, vector binary"


def signs(words: list[str], dimensions: int, seed: int) -> np.ndarray:
    """One row of -1 and 1 per word, from its hash."""
    import hashlib

    n_bytes = -(-dimensions // 8)
    raw = b"".join(hashlib.blake2b(w.encode(), digest_size=min(64, n_bytes), salt=seed.to_bytes(8, "little"), person=b"%d" % k).digest()
                   for w in words for k in range(-(-n_bytes // 64)))
    per = min(64, n_bytes) * -(-n_bytes // 64)
    bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(len(words), per), axis=1)[:, :dimensions]
    return bits.astype(np.int8) * 2 - 1


def _packed(vectors: np.ndarray) -> list[bytes]:
    """Each row in the fewest bytes that hold its whole numbers; others as doubles."""
    out: list[bytes] = [b""] * len(vectors)
    top = np.abs(vectors).max(axis=1, initial=0)
    exact = (vectors == np.rint(vectors)).all(axis=1)
    width = np.where(exact & (top < 2 ** 31), np.where(top < 2 ** 7, 1, np.where(top < 2 ** 15, 2, 4)), 8)
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        raw, size = vectors[rows].astype(WHOLE.get(w, "<f8")).tobytes(), w * vectors.shape[1]
        for k, row in enumerate(rows.tolist()):
            out[row] = raw[k * size:(k + 1) * size]
    return out


def _unpacked(column: pa.Array, dimensions: int) -> np.ndarray:
    """The rows of a column of stored vectors."""
    values = column.to_pylist()
    width = np.array([len(v) for v in values], np.int64) // dimensions
    out = np.empty((len(values), dimensions))
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        out[rows] = np.frombuffer(b"".join([values[k] for k in rows.tolist()]), WHOLE.get(w, "<f8")).reshape(-1, dimensions)
    return out


def _starts(keys: pa.Array) -> np.ndarray:
    """Where a new key (NULL is one) begins in a sorted column."""
    code = pc.dictionary_encode(keys, null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    return np.flatnonzero(np.r_[True, code[1:] != code[:-1]])


def _encoded(tokens: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words of a slice of token lists, the code of every place, and its row; blank
    places (stop words) have code -1."""
    sizes = pc.list_value_length(tokens).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.dictionary_encode(tokens.flatten())
    words = flat.dictionary.to_pylist()
    code = flat.indices.to_numpy().astype(np.int64) if len(flat) else np.zeros(0, np.int64)
    if "" in words:
        code[code == words.index("")] = -1
    return words, code, np.repeat(np.arange(len(sizes)), sizes)


def _slices(tokens: pa.Array) -> Iterator[tuple[int, int]]:
    """(first, number) of rows with about ``SLICE`` words together, or one longer text."""
    ends = np.cumsum(pc.list_value_length(tokens).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    at, before = 0, 0
    while at < len(ends):
        stop = max(at + 1, int(np.searchsorted(ends, before + SLICE, side="right")))
        yield at, stop - at
        at, before = stop, int(ends[stop - 1])


def _neighbours(dimensions: int, window: int, seed: int):
    """Token lists -> (word, n, df, summed signs of the neighbours), a row per word and flush."""
    small = np.int8 if 2 * window < 128 else np.int32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows by word; row 0 has no signs and stands for a blank place
        row_of: dict[str, int] = {}
        sign, total = np.zeros((1, dimensions), small), np.zeros((1, dimensions), np.int32)
        count, texts, places = np.zeros(1, np.int64), np.zeros(1, np.int64), 0

        def flush() -> pa.RecordBatch:
            used = slice(1, len(row_of) + 1)
            out = pa.RecordBatch.from_arrays(
                [pa.array(row_of, pa.string()), pa.array(count[used].copy()), pa.array(texts[used].copy()),
                 pa.array(_packed(total[used].astype(np.float64)), pa.binary())], ["word", "n", "df", "vector"])
            row_of.clear()
            total[:], count[:], texts[:] = 0, 0, 0
            return out

        for batch in batches:
            for at, n in _slices(batch.column(0)):
                words, code, row = _encoded(batch.column(0).slice(at, n))
                if not words:
                    continue
                before = len(row_of)
                known = np.array([row_of.setdefault(w, len(row_of) + 1) if w else 0 for w in words] + [0])
                if len(row_of) >= len(total):
                    more = 2 * len(row_of) + 1 - len(total)
                    sign, total, count, texts = (np.concatenate([a, np.zeros((more, *a.shape[1:]), a.dtype)])
                                                 for a in (sign, total, count, texts))
                if len(row_of) > before:
                    sign[before + 1:len(row_of) + 1] = signs(list(islice(row_of, before, None)), dimensions, seed)
                here = known[code]  # code -1 is the last
                around = np.zeros((len(here), dimensions), small)
                for step in range(1, min(window, len(here) - 1) + 1):
                    near = (row[step:] == row[:-step]) & (here[step:] > 0) & (here[:-step] > 0)
                    around[:-step] += sign.take(np.where(near, here[step:], 0), axis=0)
                    around[step:] += sign.take(np.where(near, here[:-step], 0), axis=0)
                order = np.argsort(code, kind="stable")
                order = order[np.searchsorted(code[order], 0):]
                if not len(order):
                    continue
                first = np.flatnonzero(np.r_[True, np.diff(code[order]) != 0])
                found = here[order[first]]
                total[found] += np.add.reduceat(around[order], first, axis=0, dtype=np.int32)
                count[found] += np.diff(np.r_[first, len(order)])
                texts[found] += np.add.reduceat(np.r_[True, (np.diff(row[order]) != 0) | (np.diff(code[order]) != 0)].astype(np.int64), first)
                places += len(order)
                # no sum of signs passes 32 bits
                if len(row_of) >= FLUSH or (places + 2 ** 27) * 2 * window >= 2 ** 31:
                    yield flush()
                    places = 0
        if row_of:
            yield flush()
    return run


def _summed(dimensions: int):
    """Rows sorted by word, (word, n, df, vector) -> one row a word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the last word, that the next batch may go on with
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([held, batch] if held else [batch]).combine_chunks()
            words = rows.column(0).combine_chunks()
            first = _starts(words)
            n, df = (np.add.reduceat(rows.column(c).to_numpy(), first) for c in (1, 2))
            total = np.add.reduceat(_unpacked(rows.column(3), dimensions), first, axis=0)
            sums = pa.RecordBatch.from_arrays([words.take(pa.array(first)), pa.array(n), pa.array(df), pa.array(_packed(total), pa.binary())],
                                              ["word", "n", "df", "vector"])
            held = sums.slice(len(first) - 1)
            if len(first) > 1:
                yield sums.slice(0, len(first) - 1)
        if held:
            yield held
    return run


def _by(df: DataFrame, key: str) -> DataFrame:
    """Rows of one key together."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key).sortWithinPartitions(key)


class WordVectors:
    """``stored``: (word, n, df, vector) of a corpus of ``n_texts`` texts, vectors of whole numbers
    or doubles."""

    def __init__(self, stored: DataFrame, n_texts: int, dimensions: int):
        self.stored, self.n_texts, self.dimensions = stored, n_texts, dimensions

    @property
    def words(self) -> DataFrame:
        """(word, n, df, vector), vectors as doubles."""
        dim = self.dimensions

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                vectors = [v.tobytes() for v in _unpacked(batch.column(3), dim)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(vectors, pa.binary())], batch.schema.names)

        return self.stored.mapInArrow(run, WORDS)

    def least_df(self, frequent: int) -> int | None:
        """The least document frequency that at most ``frequent`` words reach; None: no word does."""
        least, n = None, 0
        for df, count in self.stored.groupBy("df").count().orderBy(F.col("df").desc()).limit(frequent).collect():
            n += count
            if n > frequent:
                break
            least = df
        return least

    @classmethod
    def fit(cls, texts: DataFrame, path: str | None = None, *, text_col: str = "text", dimensions: int = DIMENSIONS,
            window: int = WINDOW, seed: int = 7) -> "WordVectors":
        """Count the whole corpus and store the word table at ``path`` (default: scratch)."""
        spark = texts.sparkSession
        path = path or scratch_path(spark, "word-vectors")
        tokens = texts.select(kept_tokens(F.coalesce(F.col(text_col), F.lit(""))).alias("tokens"))
        parts = tokens.mapInArrow(_neighbours(dimensions, window, seed), WORDS)
        _by(parts, "word").mapInArrow(_summed(dimensions), WORDS).write.parquet(path)
        return cls(spark.read.schema(WORDS).parquet(path), texts.count(), dimensions)

    def embed(self, texts: DataFrame, *, id_col: str = "id", text_col: str = "content", frequent: int = FREQUENT) -> DataFrame:
        """``(id, embedding)`` for every distinct id; rows of one id are one text's parts."""
        spark, dim = texts.sparkSession, self.dimensions
        least = self.least_df(frequent)
        shown = self.stored.where(F.lit(False) if least is None else F.col("df") >= least).select("word", "df", "vector").toArrow()
        log_n = float(np.log1p(self.n_texts))

        def weighted(df: np.ndarray, vectors: np.ndarray) -> np.ndarray:
            size = np.linalg.norm(vectors, axis=1, keepdims=True)
            unit = np.divide(vectors, size, out=np.zeros_like(vectors), where=size > 0)
            return unit * (log_n - np.log1p(df))[:, None]

        matrix = _unpacked(shown.column("vector"), dim)
        shipped = spark.sparkContext.broadcast((
            {w: k for k, w in enumerate(shown.column("word").to_pylist())},
            weighted(shown.column("df").to_numpy().astype(np.float64), matrix)))

        def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Per text its frequent words' sum (word NULL), and its other words with their counts."""
            place, table = shipped.value
            for batch in batches:
                for at, n in _slices(batch.column(1)):
                    part = batch.slice(at, n)
                    words, code, row = _encoded(part.column(1))
                    of = np.array([place.get(w, -1) for w in words], np.int64)
                    row, code = row[code >= 0], code[code >= 0]
                    known = of[code] if len(words) else code
                    total = np.zeros((part.num_rows, dim))
                    here = known >= 0
                    if here.any():
                        first = np.flatnonzero(np.r_[True, np.diff(row[here]) != 0])
                        total[row[here][first]] = np.add.reduceat(table[known[here]], first, axis=0)
                    pairs, counts = np.unique(row[~here] * max(len(words), 1) + code[~here], return_counts=True)
                    owner, rare = np.divmod(pairs, max(len(words), 1))
                    ids = pa.concat_arrays([part.column(0), part.column(0).take(pa.array(owner))])
                    yield pa.RecordBatch.from_arrays(
                        [ids, pa.array([None] * part.num_rows + [words[c] for c in rare.tolist()], pa.string()),
                         pa.array(np.r_[np.zeros(part.num_rows, np.int64), counts]),
                         pa.array([t.tobytes() for t in total] + [None] * len(owner), pa.binary())], ["id", "word", "n", "vector"])

        kind = texts.schema[id_col].dataType
        schema = T.StructType([T.StructField("id", kind), *T._parse_datatype_string("word string, n long, vector binary").fields])
        rows = texts.select(F.col(id_col).alias("id"), kept_tokens(F.coalesce(F.col(text_col), F.lit(""))).alias("tokens"))
        path = scratch_path(spark, "text-words")
        rows.mapInArrow(split, schema).write.parquet(path)
        rows = spark.read.schema(schema).parquet(path)
        rare = rows.where("word IS NOT NULL").select("id", "word", "n").join(
            self.stored.select("word", "df", F.col("vector").alias("word_vector")), "word")
        parts = rare.select("id", "n", "df", F.col("word_vector").alias("vector")).unionByName(
            rows.where("word IS NULL").select("id", "n", F.lit(None).cast("long").alias("df"), "vector"))

        def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Rows sorted by id: words with n and df, and sums as they are (df NULL) -> unit vectors."""
            held: tuple[pa.Array, np.ndarray] | None = None  # the last id, that the next batch may go on with

            def units(ids: pa.Array, totals: np.ndarray) -> pa.RecordBatch:
                size = np.linalg.norm(totals, axis=1)
                out = [(v / s).astype(np.float32) if s > 1e-12 else None for v, s in zip(totals, size)]
                return pa.RecordBatch.from_arrays([ids, pa.array(out, pa.list_(pa.float32()))], ["id", "embedding"])

            for batch in batches:
                if not batch.num_rows:
                    continue
                ids, vectors = batch.column(0), _unpacked(batch.column(3), dim)
                word = np.flatnonzero(batch.column(2).is_valid().to_numpy(zero_copy_only=False))
                df = batch.column(2).take(pa.array(word)).to_numpy().astype(np.float64)
                vectors[word] = weighted(df, vectors[word]) * batch.column(1).to_numpy()[word, None]
                if held:
                    ids, vectors = pa.concat_arrays([held[0], ids]), np.concatenate([held[1], vectors])
                first = _starts(ids)
                ids, totals = ids.take(pa.array(first)), np.add.reduceat(vectors, first, axis=0)
                held = ids.slice(len(first) - 1), totals[-1:]
                if len(first) > 1:
                    yield units(ids.slice(0, len(first) - 1), totals[:-1])
            if held:
                yield units(*held)

        final = T.StructType([T.StructField("id", kind), T.StructField("embedding", T.ArrayType(T.FloatType()))])
        return _by(parts, "id").mapInArrow(added, final).withColumnRenamed("id", id_col)
