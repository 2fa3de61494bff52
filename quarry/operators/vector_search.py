"""Exact cosine top-k of a batch of query vectors against a record table.

Plan shape (no cross join, no pair rows, no shuffle of records): a block of
queries of checked size is shipped to every task as one numpy matrix, and
``mapInArrow`` streams the record scan past it.  A task scores each Arrow batch
with matrix products, keeps a running top-k per query and emits at most ``k`` rows
per query once.  A query batch that does not fit one block is cut into blocks by a
hash of the query id, which are written to the shared folder and read by the tasks;
the scan runs once per block, and the rows do not depend on the number of blocks.

The final cut is ``row_number() <= k`` per query, which Spark runs as a partial +
final ``WindowGroupLimit``.

All query vectors must have one dimension (else ``ValueError``); NULL vectors,
zero vectors and records of another dimension match nothing; ties are broken by id
inside the task, so equal vectors never leave it beyond ``k`` per query.
"""

from __future__ import annotations

from functools import reduce
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.tags import tags_filter
from quarry.session import open_shared, scratch_path

MAX_BROADCAST_QUERIES = 65_536      # query rows of one block
FIRST_READ = 1_024                  # query rows read to see whether the batch is one small block
MAX_BROADCAST_BYTES = 64 << 20      # and never more than this many bytes
MAX_BROADCAST_HITS = 1_000_000      # queries x k hit rows joined back by broadcast


def _unit_rows(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    with np.errstate(invalid="ignore", divide="ignore"):
        return m / n


QUERY_BLOCK = 256    # queries scored together inside a task: ~20 MB of distances per 10k rows


def _first_k(query: np.ndarray, ids: np.ndarray, dist: np.ndarray, k: int):
    """The first ``k`` rows of every query by (distance, id); a tie of equal
    vectors is cut like any other."""
    order = np.lexsort((ids, dist, query))
    query, ids, dist = query[order], ids[order], dist[order]
    starts = np.flatnonzero(np.r_[True, query[1:] != query[:-1]]) if len(query) else np.empty(0, np.int64)
    place = np.arange(len(query)) - np.repeat(starts, np.diff(np.r_[starts, len(query)]))
    keep = place < k
    return query[keep], ids[keep], dist[keep]


def _score_batch(rec_unit: np.ndarray, ids: np.ndarray, q_unit: np.ndarray, k: int,
                 max_distance: float | None) -> Iterator[tuple]:
    """``(query numbers, ids, distances)`` of one record batch, QUERY_BLOCK queries at
    a time; with ``k > 0`` at most ``k`` rows per query."""
    for b in range(0, q_unit.shape[0], QUERY_BLOCK):
        dist = 1.0 - q_unit[b:b + QUERY_BLOCK] @ rec_unit.T
        valid = ~np.isnan(dist)
        if max_distance is not None:
            valid &= dist < max_distance
        if 0 < k < dist.shape[1]:
            masked = np.where(valid, dist, np.inf)
            valid &= masked <= np.partition(masked, k - 1, axis=1)[:, k - 1][:, None]
        q, r = np.nonzero(valid)
        found = (q + b, ids[r], dist[q, r])
        yield _first_k(*found, k) if k > 0 else found


def _candidates_schema(query_id_type: T.DataType) -> T.StructType:
    return T.StructType([
        T.StructField("query_id", query_id_type),
        T.StructField("id", T.StringType()),
        T.StructField("distance", T.DoubleType()),
    ])


def query_blocks(queries: DataFrame, max_queries: int) -> tuple[list, int, int | None]:
    """``(blocks, number of queries, dimension)`` of ``queries (query_id, query_vec)``.

    A small batch is one Arrow table.  A larger one is cut by a hash of the query id and
    written to the shared folder; a block is then the path of its files, which tasks read,
    so the driver never holds the batch."""
    block = queries.limit(FIRST_READ + 1).toArrow()
    sizes = {len(v) for v in block.column("query_vec").to_pylist()}
    if block.num_rows <= FIRST_READ:
        lo, hi, n_queries = min(sizes, default=None), max(sizes, default=None), block.num_rows
    else:
        lo, hi, n_queries = queries.agg(F.min(F.size("query_vec")), F.max(F.size("query_vec")), F.count("*")).first()
    if lo != hi:
        raise ValueError("query vectors must all have the same dimension")
    if not n_queries or not hi:
        return [], n_queries, hi
    rows = min(max_queries, max(1, MAX_BROADCAST_BYTES // (8 * hi)))
    if n_queries <= rows:
        return [block if block.num_rows == n_queries else queries.toArrow()], n_queries, hi
    spark = queries.sparkSession
    n_blocks = -(-2 * n_queries // rows)  # hash blocks of about half the bound
    path = scratch_path(spark, "query-blocks")
    (queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)).cast("int"))
     .repartition("block").write.partitionBy("block").parquet(path))
    found = sorted(r.block for r in spark.read.parquet(path).select("block").distinct().collect())  # n_blocks rows
    return [f"{path}/block={b}" for b in found], n_queries, hi


def block_loader(block, spark):
    """A function for tasks that gives ``(query ids, unit vectors)`` of a block."""
    if isinstance(block, str):
        def read():
            import pyarrow.parquet as pq

            store, path = open_shared(block)
            table = pq.read_table(path, filesystem=store, columns=["query_id", "query_vec"], partitioning=None)
            return (table.column("query_id").combine_chunks(),
                    _unit_rows(np.array(table.column("query_vec").to_pylist(), dtype=np.float64)))
        return read
    payload = (block.column("query_id").combine_chunks(),
               _unit_rows(np.array(block.column("query_vec").to_pylist(), dtype=np.float64)))
    try:
        shipped = spark.sparkContext.broadcast(payload)
        return lambda: shipped.value
    except Exception:  # noqa: BLE001 - no broadcast variables (Spark Connect): ship with the function
        return lambda: payload


def _block_candidates(recs: DataFrame, block, dim: int, k: int, max_distance: float | None,
                      qtype: T.DataType) -> DataFrame:
    """Candidates of one block of queries against the whole record scan."""
    get = block_loader(block, recs.sparkSession)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, q_unit = get()

        def rows(query, ids, dist) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [query_ids.take(pa.array(query)), pa.array(ids.astype(object), type=pa.string()),
                 pa.array(dist, type=pa.float64())], names=["query_id", "id", "distance"])

        best = (np.empty(0, np.int64), np.empty(0, "U1"), np.empty(0))
        for b in batches:
            if b.num_rows == 0:
                continue
            ids = np.array(b.column(0).to_pylist(), dtype=str)
            flat = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            found = _score_batch(_unit_rows(flat.reshape(b.num_rows, dim)), ids, q_unit, k, max_distance)
            if k <= 0:
                yield from (rows(*part) for part in found if len(part[0]))
                continue
            parts = [best, *found]
            best = _first_k(*[np.concatenate([p[i] for p in parts]) for i in range(3)], k)
        if len(best[0]):
            yield rows(*best)

    return recs.select("id", "embedding").mapInArrow(score, _candidates_schema(qtype))


def vector_candidates(records: DataFrame, queries: DataFrame, k: int, *,
                      min_similarity: float | None = None, filters=None,
                      max_broadcast_queries: int = MAX_BROADCAST_QUERIES) -> DataFrame:
    """``(query_id, id, distance, rank)`` - the k nearest records of every query.

    ``k <= 0`` means unlimited: every record passing the threshold, ``rank`` NULL
    (numbering all pairs of a query would need one task). Records with a NULL
    embedding never match. Ties are broken by ``id``.
    """
    return candidates_and_count(records, queries, k, min_similarity=min_similarity,
                                filters=filters, max_broadcast_queries=max_broadcast_queries)[0]


def candidates_and_count(records: DataFrame, queries: DataFrame, k: int, *,
                         min_similarity: float | None = None, filters=None,
                         max_broadcast_queries: int = MAX_BROADCAST_QUERIES):
    """``vector_candidates`` plus the number of queries."""
    qtype = queries.schema["query_id"].dataType
    max_distance = None if min_similarity is None else 1.0 - float(min_similarity)
    queries = queries.select("query_id", "query_vec").where(F.col("query_vec").isNotNull())
    blocks, n_queries, dim = query_blocks(queries, max_broadcast_queries)
    schema = T.StructType([*_candidates_schema(qtype).fields, T.StructField("rank", T.IntegerType())])
    if not blocks:
        return records.sparkSession.createDataFrame([], schema), n_queries
    recs = records.where(F.size("embedding") == dim).where(tags_filter(filters))
    parts = [_block_candidates(recs, b, dim, k, max_distance, qtype) for b in blocks]
    cand = reduce(DataFrame.unionByName, parts)
    if k <= 0:
        return cand.withColumn("rank", F.lit(None).cast("int")), n_queries
    w = Window.partitionBy("query_id").orderBy(F.col("distance").asc(), F.col("id").asc())
    return cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k), n_queries


def vector_search(records: DataFrame, queries: DataFrame, k: int = 1, *, offset: int = 0,
                  min_similarity: float | None = None, filters=None,
                  with_embeddings: bool = False) -> DataFrame:
    """Similar records per query: ``(query_id, id, tags, content, payload,
    [embedding,] distance, similarity, rank)`` with ``rank`` 1-based after the
    offset. ``k <= 0`` means no limit. The threshold is strict:
    ``distance < 1 - min_similarity``."""
    if offset < 0:
        raise ValueError("offset must be >= 0")
    cand, n_queries = candidates_and_count(records, queries, (k + offset) if k > 0 else 0,
                                           min_similarity=min_similarity, filters=filters)
    if offset:
        cand = cand.where(F.col("rank") > offset).withColumn("rank", F.col("rank") - offset)
    cols = ["id", "tags", "content", "payload"] + (["embedding"] if with_embeddings else [])
    # The hits are bounded by queries x k when k > 0; broadcast them into the
    # record scan so the record table is not shuffled to attach its columns.
    hits = F.broadcast(cand) if 0 < k and n_queries * (k + offset) <= MAX_BROADCAST_HITS else cand
    return (records.select(*cols).join(hits, "id")
            .withColumn("similarity", F.lit(1.0) - F.col("distance"))
            .select("query_id", *cols, "distance", "similarity", "rank"))


def hashing_embedder(num_features: int = 64, text_col: str = "content", out_col: str = "embedding"):
    """A model-free text embedder for tests and baselines: word tokens ->
    feature hashing -> IDF -> L2 normalisation, as ``array<float>``.
    Returns ``fit(corpus) -> transform(df)``; any real model plugs in the same
    way as a Column expression or a pandas UDF."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
    from pyspark.ml.functions import vector_to_array

    stages = [RegexTokenizer(inputCol=text_col, outputCol="__tok", pattern=r"[^\p{L}\p{N}]+"),
              HashingTF(inputCol="__tok", outputCol="__tf", numFeatures=num_features),
              IDF(inputCol="__tf", outputCol="__idf"),
              Normalizer(inputCol="__idf", outputCol="__vec", p=2.0)]

    def fit(corpus: DataFrame):
        model = Pipeline(stages=stages).fit(corpus)

        def transform(df: DataFrame) -> DataFrame:
            out = model.transform(df)
            return (out.withColumn(out_col, vector_to_array("__vec", "float32"))
                    .drop("__tok", "__tf", "__idf", "__vec"))
        return transform
    return fit
