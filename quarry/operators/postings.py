"""Ranked full-text search over saved positional postings.

Index (one scan of the records, no join):

    blocks  (lexeme, grp, n, max_tf, min_length, block)
            the postings of one lexeme in one group of records; a record's group is a hash
            of its id, so blocks of all lexemes line up, and a lexeme that every record
            holds is ``groups`` blocks in many files, never one.  ``block`` packs the ids,
            record lengths and positions (``pack``), so a scan decodes those it joins only
    stats   (lexeme, df)

Records are tokenised in the JVM; a task turns each Arrow batch into postings and, with a
stemmer, stems every distinct word of the batch once.

Search of a batch of queries:

1. every query's lexemes meet ``stats``; a query with an unknown lexeme matches nothing, and
   the rarest lexeme is its key;
2. where a key has more than ``FIRST * k`` postings, the blocks' narrow columns give, per
   query and group, whether all lexemes occur in the group and an upper bound of any score in
   it: a record has at most as many minimal covers as hits of the query less the other
   lexemes, each worth ``COVER_WEIGHT`` at most (divided, for normalised scores, by the
   logarithm of the shortest record).  The groups of the highest bounds are searched first,
   until their key postings number ``FIRST * k``; of the other groups those whose bound
   reaches a query's k-th score so far follow, and the rest are not searched;
3. in a group, the key's block gives the candidates; the blocks of the query's other lexemes
   in the same group are cut to them inside the row, and a record that all lexemes leave is
   scored by the cover density of its positions.

The records' token arrays are neither stored nor read.  Results equal ``text_search``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.stopwords import FRENCH
from quarry.operators.text_search import COVER_WEIGHT, cover_density, kept_tokens
from quarry.session import scratch_path

GROUP, FIRST = 2_048, 8
MAX_BROADCAST_ROWS = 500_000   # rows of the query side that are broadcast
BLOCKS = "lexeme string, grp int, n int, max_tf int, min_length int, block binary"
POSTINGS = "lexeme string, grp int, id string, length int, positions array<int>"


def _stemmed(words: pa.Array, stemmer, known: dict[str, str]) -> pa.Array:
    """The distinct words of a batch, each stemmed once (and remembered for the task)."""
    if stemmer is None:
        return words
    if len(known) > 1_000_000:
        known.clear()
    out = []
    for w in words.to_pylist():
        if w not in known:
            known[w] = stemmer(w) if w else w
        out.append(known[w])
    return pa.array(out, pa.string())


def _postings(stemmer: Callable[[str], str] | None):
    """Rows (id, grp, tokens) -> one row per record and lexeme."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, str] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                tokens = part.column(2)
                sizes = pc.list_value_length(tokens).to_numpy(zero_copy_only=False).astype(np.int64)
                encoded = pc.dictionary_encode(tokens.flatten())
                words = _stemmed(encoded.dictionary, stemmer, known)
                again = pc.dictionary_encode(words)  # words of one stem become one lexeme
                lexeme = again.indices.to_numpy()[encoded.indices.to_numpy()] if len(encoded) else np.zeros(0, np.int64)
                row = np.repeat(np.arange(part.num_rows), sizes)
                pos = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1
                names = again.dictionary
                blank = pc.index(names, pa.scalar("")).as_py() if len(names) else -1
                keep = lexeme != blank
                row, pos, lexeme = row[keep], pos[keep], lexeme[keep]
                length = np.bincount(row, minlength=part.num_rows)
                order = np.lexsort((pos, lexeme, row))
                row, pos, lexeme = row[order], pos[order], lexeme[order]
                first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (lexeme[1:] != lexeme[:-1])]) if len(row) else row
                ends = np.r_[first, len(row)].astype(np.int32)
                owner = pa.array(row[first])
                yield pa.RecordBatch.from_arrays(
                    [names.take(pa.array(lexeme[first])) if len(first) else pa.array([], pa.string()),
                     part.column(1).take(owner), part.column(0).take(owner), pa.array(length[row[first]].astype(np.int32)),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(pos.astype(np.int32)))],
                    ["lexeme", "grp", "id", "length", "positions"])
    return run


def pack(ids: bytes, sizes: np.ndarray, lengths: np.ndarray, tf: np.ndarray, positions: np.ndarray) -> bytes:
    """A block: the number of records, bytes of each id, record lengths, positions of each,
    all positions, and the ids (32-bit integers, then UTF-8)."""
    head = np.concatenate([[len(sizes)], sizes, lengths, tf, positions]).astype("<i4")
    return head.tobytes() + ids


def unpack_ids(block: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray, int]:
    """``(ids, record lengths, ends of their positions, place of the positions)``."""
    n = int.from_bytes(block[:4], "little")
    head = np.frombuffer(block, "<i4", 1 + 3 * n)
    ends, at = np.cumsum(head[1 + 2 * n:]), 4 * (1 + 3 * n)
    stops = at + 4 * int(ends[-1]) + np.cumsum(head[1:1 + n])
    starts = stops - head[1:1 + n]
    return [block[a:b] for a, b in zip(starts.tolist(), stops.tolist())], head[1 + n:1 + 2 * n], ends, at


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings sorted by (lexeme, grp, id) -> one row per lexeme and group."""
    def rows(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        lexeme, grp, ids, lengths, positions = (table.column(c).combine_chunks() for c in range(5))
        n = table.num_rows
        ids = ids.cast(pa.large_binary())
        at = np.frombuffer(ids.buffers()[1], np.int64)[ids.offset:ids.offset + n + 1]
        data = memoryview(ids.buffers()[2] or b"")
        lengths = lengths.to_numpy()
        tf = pc.list_value_length(positions).to_numpy(zero_copy_only=False)
        flat, place = positions.flatten().to_numpy(), np.r_[0, np.cumsum(tf)]
        ends = np.r_[starts[1:], n]
        packed = [pack(bytes(data[at[a]:at[b]]), np.diff(at[a:b + 1]), lengths[a:b], tf[a:b], flat[place[a]:place[b]])
                  for a, b in zip(starts.tolist(), ends.tolist())]
        first = pa.array(starts)
        return pa.RecordBatch.from_arrays(
            [lexeme.take(first), grp.take(first), pa.array((ends - starts).astype(np.int32)),
             pa.array(np.maximum.reduceat(tf, starts).astype(np.int32)),
             pa.array(np.minimum.reduceat(lengths, starts).astype(np.int32)), pa.array(packed, pa.binary())],
            ["lexeme", "grp", "n", "max_tf", "min_length", "block"])

    held: list[pa.RecordBatch] = []  # rows of the block that the next batch may go on with
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([*held, batch])
        code = pc.dictionary_encode(table.column(0).combine_chunks()).indices.to_numpy()
        grp = table.column(1).combine_chunks().to_numpy()
        starts = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (grp[1:] != grp[:-1])])
        last = int(starts[-1])
        if last:
            yield rows(table.slice(0, last), starts[:-1])
        held = table.slice(last).to_batches()
    if held:
        yield rows(pa.Table.from_batches(held), np.zeros(1, np.int64))


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (query_id, n_terms, term, candidates, block) -> hits of the candidates in the block."""
    names = ["query_id", "n_terms", "id", "length", "term", "positions"]
    for batch in batches:
        row, ids, lengths, positions = [], [], [], []
        for k in range(batch.num_rows):
            wanted = set(unpack_ids(batch.column(3)[k].as_py())[0])
            block = batch.column(4)[k].as_py()
            found, sizes, ends, start = unpack_ids(block)
            for i, id_ in enumerate(found):
                if id_ in wanted:
                    first = int(ends[i - 1]) if i else 0
                    row.append(k)
                    ids.append(id_)
                    lengths.append(int(sizes[i]))
                    positions.append(np.frombuffer(block, "<i4", int(ends[i]) - first, start + 4 * first))
        at = pa.array(row, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(at), batch.column(1).take(at), pa.array(ids, pa.binary()).cast(pa.string()),
             pa.array(lengths, pa.int32()), batch.column(2).take(at), pa.array(positions, pa.list_(pa.int32()))], names)


class PostingsIndex:
    """Saved postings of a record table, with the stemmer they were made by."""

    def __init__(self, blocks: DataFrame, stats: DataFrame, stemmer=None, stop_words=FRENCH):
        self.blocks, self.stats, self.stemmer, self.stop_words = blocks, stats, stemmer, stop_words

    @classmethod
    def save(cls, records: DataFrame, path: str, *, stemmer: Callable[[str], str] | None = None, stop_words=FRENCH,
             groups: int | None = None) -> "PostingsIndex":
        """Index ``records (id, content)`` at ``path``.  ``stemmer`` is a function of one
        word (e.g. ``quarry.functions.french.stem``); ``groups`` is by default a group for
        every ``GROUP`` records, which bounds a block."""
        spark = records.sparkSession
        groups = groups or max(1, -(-records.count() // GROUP))
        grp = F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int")
        tokens = kept_tokens(F.coalesce("content", F.lit("")), stop_words=stop_words)
        rows = records.select("id", grp.alias("grp"), tokens.alias("tokens")).mapInArrow(_postings(stemmer), POSTINGS)
        # by (lexeme, grp): a block is one task's, a frequent lexeme is many
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))  # given, so that few bytes do not become one file
        (rows.repartitionByRange(n, "lexeme", "grp").sortWithinPartitions("lexeme", "grp", "id").mapInArrow(_blocks, BLOCKS)
         .write.mode("errorifexists").parquet(f"{path}/blocks"))
        written = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
        stats = written.groupBy("lexeme").agg(F.sum("n").cast("long").alias("df"))
        stats.repartitionByRange("lexeme").sortWithinPartitions("lexeme").write.parquet(f"{path}/stats")
        return cls.load(spark, path, stemmer=stemmer, stop_words=stop_words)

    @classmethod
    def load(cls, spark: SparkSession, path: str, *, stemmer=None, stop_words=FRENCH) -> "PostingsIndex":
        return cls(spark.read.schema(BLOCKS).parquet(f"{path}/blocks"),
                   spark.read.schema("lexeme string, df long").parquet(f"{path}/stats"), stemmer, stop_words)

    def query_terms(self, queries: DataFrame) -> DataFrame:
        """``(query_id, term, lexeme, n_terms)``: the distinct lexemes of every query, by the
        index's own rules; queries without a lexeme are left out."""
        words = F.array_distinct(F.filter(kept_tokens("query_text", stop_words=self.stop_words), lambda w: w != ""))
        rows = queries.select("query_id", words.alias("words"))
        if self.stemmer is not None:
            stemmer = self.stemmer

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    stems = [None if ws is None else sorted({s for s in map(stemmer, ws) if s}) for ws in batch.column(1).to_pylist()]
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(stems, pa.list_(pa.string()))], ["query_id", "words"])

            rows = rows.mapInArrow(run, T.StructType([rows.schema["query_id"], T.StructField("words", T.ArrayType(T.StringType()))]))
        return rows.select("query_id", F.size("words").alias("n_terms"), F.posexplode("words").alias("term", "lexeme"))

    def _known(self, queries: DataFrame) -> tuple[DataFrame, int | None]:
        """``(query_id, term, lexeme, n_terms, is_key)`` of the queries whose lexemes all
        occur; for a small batch, the postings of the longest key list."""
        spark = queries.sparkSession
        terms = self.query_terms(queries)
        schema = terms.schema
        few = terms.limit(MAX_BROADCAST_ROWS // 10 + 1).collect()  # a bounded read: the usual batch is small
        if len(few) > MAX_BROADCAST_ROWS // 10:
            by_query = Window.partitionBy("query_id")
            met = terms.join(self.stats, "lexeme").withColumns({
                "found": F.count("*").over(by_query), "place": F.row_number().over(by_query.orderBy("df", "lexeme"))})
            met = met.where("found = n_terms").select(*schema.names, (F.col("place") == 1).alias("is_key"))
            path = scratch_path(spark, "query-terms")
            met.write.parquet(path)
            return spark.read.schema(met.schema).parquet(path), None
        asked = _local(spark, [(w,) for w in sorted({r.lexeme for r in few})], T.StructType([T.StructField("lexeme", T.StringType())]))
        df = {r.lexeme: r.df for r in self.stats.join(F.broadcast(asked), "lexeme").collect()}  # no more rows than were read
        of: dict = {}
        for r in few:
            of.setdefault(r.query_id, []).append(r)
        known = []
        for rows in of.values():
            if all(r.lexeme in df for r in rows):
                key = min(rows, key=lambda r: (df[r.lexeme], r.lexeme)).lexeme
                known += [(*r, r.lexeme == key) for r in rows]
        met = _local(spark, known, T.StructType([*schema.fields, T.StructField("is_key", T.BooleanType())]))
        at = schema.names.index("lexeme")
        return met, max((df[r[at]] for r in known if r[-1]), default=0)

    def _score(self, terms: DataFrame, longest: int | None, pairs: DataFrame | None, length_norm: bool) -> DataFrame:
        """``(query_id, id, text_score)`` of the matches, in the given (query_id, grp) pairs only
        if there are any."""
        small = F.broadcast if longest is not None else (lambda df: df)
        # the key lists of a small batch, once a lexeme of their query, are of bounded size
        bounded = longest is not None and longest <= MAX_BROADCAST_ROWS // 100
        blocks = self.blocks.select("lexeme", "grp", "block")
        if not bounded:
            # both sides of the join are cut first, by narrow columns: to the groups that hold all
            # lexemes of a query, and to the blocks of that query's lexemes in them
            if pairs is None:
                pairs = self._pairs(terms, longest, length_norm).select("query_id", "grp")
            asked = terms.select("query_id", "lexeme").join(pairs, "query_id").select("lexeme", "grp").distinct()
            if longest is not None:  # few lexemes: the scan drops the others before anything is moved
                blocks = blocks.join(F.broadcast(terms.select("lexeme").distinct()), "lexeme", "left_semi")
            few = asked.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS
            blocks = blocks.join(F.broadcast(asked) if few else asked, ["lexeme", "grp"], "left_semi")
        keys = terms.where("is_key").select("query_id", "lexeme")
        candidates = self.blocks.select("lexeme", "grp", F.col("block").alias("candidates")).join(small(keys), "lexeme").drop("lexeme")
        if pairs is not None:
            candidates = candidates.join(small(pairs), ["query_id", "grp"], "left_semi")
        wanted = candidates.join(small(terms), "query_id").select("query_id", "grp", "candidates", "term", "lexeme", "n_terms")
        rows = blocks.join(F.broadcast(wanted) if bounded else wanted, ["lexeme", "grp"])
        rows = rows.select("query_id", "n_terms", "term", "candidates", "block").mapInArrow(_met, T.StructType([
            terms.schema["query_id"], *T._parse_datatype_string(
                "n_terms int, id string, length int, term int, positions array<int>").fields]))
        hits = F.transform("positions", lambda x: F.struct(x.alias("pos"), F.col("term").alias("term")))
        matched = rows.withColumn("hits", hits).groupBy("query_id", "id", "n_terms").agg(
            F.count("*").alias("found"), F.max("length").alias("length"), F.collect_list("hits").alias("hits")).where("found = n_terms")
        matched = matched.withColumn("hits", F.array_sort(F.flatten("hits")))
        score = cover_density(F.col("hits"), F.col("n_terms"))
        if length_norm:
            score = score / F.log(F.col("length") + F.lit(1.0))
        return matched.select("query_id", "id", score.alias("text_score"))

    def _pairs(self, terms: DataFrame, longest: int | None, length_norm: bool) -> DataFrame:
        """``(query_id, grp, n_key, bound)`` of the groups that hold all lexemes of a query."""
        small = F.broadcast if longest is not None else (lambda df: df)
        met = self.blocks.select("lexeme", "grp", "n", "max_tf", "min_length").join(small(terms), "lexeme")
        pairs = met.groupBy("query_id", "grp", "n_terms").agg(
            F.count("*").alias("found"), F.sum("max_tf").alias("hits"), F.max("min_length").alias("shortest"),
            F.max(F.when(F.col("is_key"), F.col("n"))).alias("n_key")).where("found = n_terms")
        bound = F.lit(COVER_WEIGHT) * (F.col("hits") - F.col("n_terms") + 1)
        if length_norm:
            bound = bound / F.log(F.col("shortest") + F.lit(1.0))
        return pairs.select("query_id", "grp", "n_key", bound.alias("bound"))

    def matches(self, queries: DataFrame) -> DataFrame:
        """``(query_id, id)``: records that hold every lexeme of the query."""
        terms, longest = self._known(queries)
        return self._score(terms, longest, None, False).select("query_id", "id")

    def search(self, queries: DataFrame, k: int | None = None, *, length_norm: bool = False,
               only: DataFrame | None = None) -> DataFrame:
        """``(query_id, id, text_score, text_rank)`` as ``text_search`` gives them.  ``only
        (id)`` limits the matches; the bounds then skip nothing, as scores of records
        outside it do not count."""
        terms, longest = self._known(queries)
        if k is None or k <= 0 or only is not None or (longest is not None and longest <= FIRST * k):
            scored = self._score(terms, longest, None, length_norm)
            if only is not None:
                scored = scored.join(only.select("id"), "id", "left_semi").select("query_id", "id", "text_score")
            if k is None or k <= 0:
                return scored.withColumn("text_rank", F.lit(None).cast("int"))
            return _first_k(scored, k)
        spark = queries.sparkSession
        before = F.sum("n_key").over(Window.partitionBy("query_id").orderBy(F.col("bound").desc(), "grp")
                                     .rowsBetween(Window.unboundedPreceding, -1))
        pairs = self._pairs(terms, longest, length_norm).withColumn("late", F.coalesce(before, F.lit(0)) >= FIRST * k)
        path = scratch_path(spark, "text-groups")
        pairs.write.parquet(path)
        pairs = spark.read.schema(pairs.schema).parquet(path)
        first = self._score(terms, longest, pairs.where("NOT late").select("query_id", "grp"), length_norm)
        path = scratch_path(spark, "text-first")
        _first_k(first, k).write.parquet(path)
        held = spark.read.schema(T.StructType([first.schema["query_id"], *T._parse_datatype_string(
            "id string, text_score double, text_rank int").fields])).parquet(path)
        kth = held.where(F.col("text_rank") == k).select("query_id", F.col("text_score").alias("kth"))
        # a group whose bound equals the k-th score may hold a tie with a smaller id
        rest = (pairs.where("late").join(kth, "query_id", "left").where("kth IS NULL OR bound * 1.000001 >= kth")
                .select("query_id", "grp"))
        return _first_k(held.drop("text_rank").unionByName(self._score(terms, longest, rest, length_norm)), k)


def _local(spark: SparkSession, rows: list, schema: T.StructType) -> DataFrame:
    """A local relation of few rows (through Arrow: a list would be a Python scan per use)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    columns = list(zip(*rows)) if rows else [[] for _ in schema.fields]
    arrow = to_arrow_schema(schema)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow), schema)


def _first_k(scored: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.col("text_score").desc(), F.col("id").asc())
    return scored.withColumn("text_rank", F.row_number().over(w)).where(F.col("text_rank") <= k)
