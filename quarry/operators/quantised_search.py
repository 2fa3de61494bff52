"""Approximate cosine top-k over product-quantised vectors.

Index.  Unit vectors are cut into ``parts`` sub-vectors; each sub-space has a codebook of up
to 256 centroids, so a record is ``parts`` bytes.  Codebooks come from k-means on a bounded
sample (``sample`` records, the first by a hash of their id), one Spark task per sub-space;
every record is encoded.  A saved index holds

    codebooks   (part, centroids)       a few hundred KB, read by the driver
    codes       (id, tags, code)        what a search scans
    vectors     (shard, id, embedding)  unit vectors in hash shards, sorted by id

Search.  A task looks up, per query and sub-space, the products with all centroids once and
scores a record by ``parts`` table lookups and additions; it keeps the best ``rerank`` codes
per query.  After the global cut, only those records' vectors are read (the shards that hold
one) and scored exactly; the first ``k`` stay.  So queries x rerank full-width distances are
taken whatever the number of records, and the distances returned are exact.

Defined cases: NULL and zero vectors are not indexed; vectors of another dimension than the
first sampled one, or NaN, raise in the encoding task; a query without a vector, or with a
zero one, matches nothing; fewer records than centroids give each its own; a table without
vectors makes an index that matches nothing; ties go by id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.tags import tags_filter
from quarry.functions.vectors import cosine_distance
from quarry.operators.vector_search import (MAX_BROADCAST_HITS, MAX_BROADCAST_QUERIES, QUERY_BLOCK, _first_k, _unit_rows,
                                            block_loader, query_blocks)

PARTS, CODES, SAMPLE, ROUNDS, SHARDS = 16, 256, 16_384, 12, 64


def part_bounds(dim: int, parts: int) -> list[int]:
    """Where the sub-spaces begin and end: widths differ by one at most."""
    return [dim * k // parts for k in range(parts + 1)]


def k_means(x: np.ndarray, n: int, rounds: int) -> np.ndarray:
    """``n`` centroids at most, seeded by the first distinct rows (rows come in hash order)."""
    seeds = x[np.sort(np.unique(x, axis=0, return_index=True)[1])[:n]].copy()
    for _ in range(rounds if len(seeds) == n else 0):
        of = nearest(x, seeds)
        count = np.bincount(of, minlength=n)
        total = np.stack([np.bincount(of, x[:, c], minlength=n) for c in range(x.shape[1])], axis=1)
        seeds = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], seeds)
    return seeds


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.argmin((centroids ** 2).sum(1) - 2.0 * (x @ centroids.T), axis=1)


def _vectors(batch: pa.RecordBatch, column: int, dim: int) -> np.ndarray:
    flat = batch.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(flat) != batch.num_rows * dim:
        raise ValueError(f"vectors of the index must have {dim} values")
    return flat.reshape(batch.num_rows, dim)


def fit_codebooks(records: DataFrame, *, parts: int = PARTS, codes: int = CODES, sample: int = SAMPLE,
                  rounds: int = ROUNDS) -> tuple[int, list[np.ndarray]]:
    """(dimension, centroids of every sub-space) from at most ``sample`` records."""
    if not 1 <= codes <= 256:
        raise ValueError("a code is one byte: 1 to 256 centroids")
    spark = records.sparkSession
    some = (records.orderBy(F.xxhash64("id"), "id").select("embedding").limit(sample).toArrow()
            .column("embedding").to_pylist())
    if not some:
        return 0, []
    dim = len(some[0])
    known = _unit_rows(np.array([v for v in some if len(v) == dim], np.float64))
    bounds = part_bounds(dim, min(parts, dim))
    shipped = spark.sparkContext.broadcast(known)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                found = k_means(shipped.value[:, bounds[k]:bounds[k + 1]], codes, rounds)
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([found.tobytes()], pa.binary())],
                                                 ["part", "centroids"])

    n = len(bounds) - 1
    rows = spark.range(0, n, 1, n).mapInArrow(train, "part int, centroids binary").collect()  # one small row a part
    books = {r.part: np.frombuffer(bytes(r.centroids)).reshape(-1, bounds[r.part + 1] - bounds[r.part]) for r in rows}
    return dim, [books[k] for k in range(n)]


class QuantisedIndex:
    """Codebooks, codes and vectors of a record table."""

    def __init__(self, dim: int, books: list[np.ndarray], codes: DataFrame, vectors: DataFrame, shards: int):
        self.dim, self.books, self.codes, self.vectors, self.shards = dim, books, codes, vectors, shards

    @classmethod
    def save(cls, records: DataFrame, path: str, *, parts: int = PARTS, codes: int = CODES, sample: int = SAMPLE,
             rounds: int = ROUNDS, shards: int = SHARDS) -> "QuantisedIndex":
        """Fit, encode every record of ``records (id, embedding[, tags])`` and write the index."""
        spark = records.sparkSession
        tags = F.col("tags") if "tags" in records.columns else F.array().cast("array<string>")
        usable = records.select("id", tags.alias("tags"), "embedding").where(
            F.col("embedding").isNotNull() & F.exists("embedding", lambda v: v != 0))
        dim, books = fit_codebooks(usable, parts=parts, codes=codes, sample=sample, rounds=rounds)
        bounds = part_bounds(dim, max(len(books), 1))
        shipped = spark.sparkContext.broadcast(books)

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                unit = _unit_rows(_vectors(batch, 2, dim))
                if np.isnan(unit).any():
                    raise ValueError("a vector holds NaN")
                code = np.stack([nearest(unit[:, bounds[k]:bounds[k + 1]], book) for k, book in enumerate(shipped.value)],
                                axis=1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array([row.tobytes() for row in code], pa.binary()),
                     pa.array(list(unit.astype(np.float64)), pa.list_(pa.float64()))], ["id", "tags", "code", "embedding"])

        # one pass over the records writes codes and vectors; the narrow code table is split off it
        both = usable.mapInArrow(encode, "id string, tags array<string>, code binary, embedding array<double>")
        shard = F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        piece = F.pmod(F.hash("id"), F.lit(max(1, n // shards)))  # several tasks a shard where there are more tasks
        (both.withColumn("shard", shard).repartition(n, "shard", piece).sortWithinPartitions("shard", "id")
         .write.partitionBy("shard").parquet(f"{path}/vectors"))
        whole = (spark.read.schema("id string, tags array<string>, code binary, embedding array<double>, shard int")
                 .parquet(f"{path}/vectors"))
        whole.select("id", "tags", "code").write.parquet(f"{path}/codes")
        rows = [(k, dim, shards, bytearray(book.tobytes())) for k, book in enumerate(books)]
        spark.createDataFrame(rows, "part int, dim int, shards int, centroids binary").coalesce(1).write.parquet(f"{path}/codebooks")
        return cls.load(spark, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "QuantisedIndex":
        rows = sorted(spark.read.parquet(f"{path}/codebooks").collect(), key=lambda r: r.part)  # one row a part
        if not rows:
            none = spark.createDataFrame([], "id string, tags array<string>, code binary, embedding array<double>, shard int")
            return cls(0, [], none, none, 1)
        dim, shards = rows[0].dim, rows[0].shards
        bounds = part_bounds(dim, len(rows))
        books = [np.frombuffer(bytes(r.centroids)).reshape(-1, bounds[r.part + 1] - bounds[r.part]) for r in rows]
        return cls(dim, books, spark.read.schema("id string, tags array<string>, code binary").parquet(f"{path}/codes"),
                   spark.read.schema("id string, embedding array<double>, shard int").parquet(f"{path}/vectors"), shards)

    def candidates(self, block, qtype: T.DataType, rerank: int, filters=None) -> DataFrame:
        """``(query_id, id, code_score)``: per task the ``rerank`` best codes of every query."""
        bounds, books = part_bounds(self.dim, len(self.books)), self.books
        get = block_loader(block, self.codes.sparkSession)

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            query_ids, unit = get()
            best = (np.empty(0, np.int64), np.empty(0, "U1"), np.empty(0))
            tables: dict[int, list[np.ndarray]] = {}
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids = np.array(batch.column(0).to_pylist(), dtype=str)
                codes = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, len(books)).T
                parts = [best]
                for at in range(0, len(unit), QUERY_BLOCK):
                    if at not in tables:
                        if len(tables) >= 16:  # a few MB of tables at a time
                            tables.clear()
                        rows = unit[at:at + QUERY_BLOCK]
                        tables[at] = [(-rows[:, bounds[k]:bounds[k + 1]] @ book.T).astype(np.float32)
                                      for k, book in enumerate(books)]
                    total = np.zeros((len(tables[at][0]), len(ids)), np.float32)
                    for looked_up, code in zip(tables[at], codes):
                        total += looked_up[:, code]
                    valid = ~np.isnan(total)
                    if rerank < total.shape[1]:
                        last = np.partition(np.where(valid, total, np.inf), rerank - 1, axis=1)[:, rerank - 1]
                        valid &= total <= last[:, None]
                    q, r = np.nonzero(valid)
                    parts.append(_first_k(q + at, ids[r], total[q, r].astype(np.float64), rerank))
                best = _first_k(*[np.concatenate([p[i] for p in parts]) for i in range(3)], rerank)
            if len(best[0]):
                yield pa.RecordBatch.from_arrays(
                    [query_ids.take(pa.array(best[0])), pa.array(best[1].astype(object), pa.string()), pa.array(best[2])],
                    ["query_id", "id", "code_score"])

        schema = T.StructType([T.StructField("query_id", qtype), T.StructField("id", T.StringType()),
                               T.StructField("code_score", T.DoubleType())])
        return self.codes.where(tags_filter(filters)).select("id", "code").mapInArrow(score, schema)

    def search(self, queries: DataFrame, k: int, *, rerank: int | None = None, min_similarity: float | None = None,
               filters=None, max_broadcast_queries: int = MAX_BROADCAST_QUERIES) -> DataFrame:
        """``(query_id, id, distance, rank)``: the first ``k`` by exact distance (then id) of
        the ``rerank`` (default ``10 k``) records with the nearest codes."""
        if k <= 0:
            raise ValueError("k must be > 0")
        rerank = max(k, 10 * k if rerank is None else rerank)
        spark, qtype = queries.sparkSession, queries.schema["query_id"].dataType
        queries = queries.select("query_id", "query_vec").where(F.col("query_vec").isNotNull())
        blocks, n_queries, dim = query_blocks(queries, max_broadcast_queries)
        schema = T.StructType([T.StructField("query_id", qtype), *T._parse_datatype_string(
            "id string, distance double, rank int").fields])
        if not self.books or not n_queries:
            return spark.createDataFrame([], schema)
        if dim != self.dim:
            raise ValueError(f"query vectors must have {self.dim} values")
        found = None
        for block in blocks:
            part = self.candidates(block, qtype, rerank, filters)
            found = part if found is None else found.unionByName(part)
        if len(blocks) == 1 and not isinstance(blocks[0], str):
            queries = spark.createDataFrame(blocks[0])  # the batch at hand: it is not read again
        by_code = Window.partitionBy("query_id").orderBy("code_score", "id")
        best = (found.withColumn("place", F.row_number().over(by_code)).where(F.col("place") <= rerank)
                .select("query_id", "id", F.pmod(F.xxhash64("id"), F.lit(self.shards)).cast("int").alias("shard"))
                .join(queries, "query_id"))
        if n_queries * rerank <= MAX_BROADCAST_HITS:
            best = F.broadcast(best)
        distance = cosine_distance("query_vec", "embedding")
        near = self.vectors.join(best, ["shard", "id"]).select("query_id", "id", distance.alias("distance"))
        near = near.where(F.col("distance").isNotNull())
        if min_similarity is not None:
            near = near.where(F.col("distance") < 1.0 - float(min_similarity))
        w = Window.partitionBy("query_id").orderBy("distance", "id")
        return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def approx_vector_search(records: DataFrame, queries: DataFrame, k: int, *, index: QuantisedIndex | None = None,
                         rerank: int | None = None, min_similarity: float | None = None, filters=None,
                         **fit) -> DataFrame:
    """Approximate top-k: ``(query_id, id, distance, rank)``.  Without an ``index`` one is
    fitted and written to the shared folder first; save one to serve many batches."""
    from quarry.session import scratch_path

    if k <= 0:
        raise ValueError("k must be > 0")
    index = index or QuantisedIndex.save(records, scratch_path(records.sparkSession, "quantised"), **fit)
    return index.search(queries, k, rerank=rerank, min_similarity=min_similarity, filters=filters)
