"""Readers for the parquet tables and the record / query fixtures built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.tags import DOCUMENT_TAG
from quarry.session import scratch_path, state_shared

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def spread(df: DataFrame) -> DataFrame:
    """Round-robin repartition a scan that yields fewer partitions than the
    cluster has task slots (e.g. one large single-row-group file), so per-row
    work (tokenising, scoring) uses every core.  A no-op for wide scans, which
    is the normal case on a cluster.  Projections and filters are still pushed
    below the repartition into the scan."""
    try:
        slots = df.sparkSession.sparkContext.defaultParallelism
        narrow = df.rdd.getNumPartitions() < slots
    except Exception:  # noqa: BLE001 - e.g. a Spark Connect session: leave the scan as is
        return df
    return df.repartition(slots) if narrow else df


def read_table(spark: SparkSession, sf_dir: str, name: str, widen: bool = True) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread(df) if widen else df


def records_from(documents: DataFrame, embeddings: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Record table ``(id, embedding, tags, content, payload)`` of all documents, with ``extra``
    columns of theirs; ``embedding`` (``vec_id = doc_id``) is NULL where a document has none."""
    d = documents.alias("d")
    e = embeddings.alias("e")
    return (d.join(e, F.col("d.doc_id") == F.col("e.vec_id"), "left")
            .select(
                F.col("d.doc_id").cast("string").alias("id"),
                F.col("e.embedding").alias("embedding"),
                F.array(F.concat(F.lit("lang:"), F.col("d.lang")),
                        F.concat(F.lit("source:"), F.col("d.source")),
                        F.concat(F.lit(DOCUMENT_TAG + ":"), F.col("d.doc_id").cast("string"))
                        ).alias("tags"),
                F.col("d.text").alias("content"),
                F.to_json(F.struct(F.col("d.source").alias("source"),
                                   F.col("d.n_chars").alias("n_chars"))).alias("payload"),
                *[F.col(f"d.{c}") for c in extra]))


def records(spark: SparkSession, sf_dir: str, **extra: Column) -> DataFrame:
    """``extra``: further columns, computed from those of a document in the scan, so that where
    they alone are asked for, no text goes through the join."""
    # the documents carry the per-row work; the embeddings side of the join is
    # left as scanned (Spark broadcasts it when its size allows)
    documents = read_table(spark, sf_dir, "documents", widen=False).withColumns(extra) if extra else None
    return records_from(read_table(spark, sf_dir, "documents") if documents is None else spread(documents),
                        read_table(spark, sf_dir, "embeddings", widen=False), tuple(extra))


def query_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item as a query: ``(query_id, query_text, query_vec)``.

    The text is the whole passage; the vector is the embedding with
    ``vec_id = item_id``, NULL where there is none (vector searches skip such a question,
    text searches do not)."""
    b = read_table(spark, sf_dir, "benchmark", widen=False).alias("b")
    e = read_table(spark, sf_dir, "embeddings", widen=False).alias("e")
    return (b.join(e, F.col("b.item_id") == F.col("e.vec_id"), "left")
            .select(F.col("b.item_id").alias("query_id"), F.col("b.text").alias("query_text"),
                    F.col("e.embedding").alias("query_vec")))


_DERIVED: dict[tuple[str, str, str], object] = {}  # (session, kind, state of the files) -> what was loaded


def derived(spark: SparkSession, sf_dir: str, tables: list[str], kind: str, build):
    """What ``build(path)`` makes from ``tables``: built once per session and state of the
    tables (bytes, number of files, time of the last change), so a changed one is built anew."""
    paths = [f"{sf_dir.rstrip('/')}/{t}.parquet" for t in tables]
    key = (spark.sparkContext.applicationId, kind, str([(p, state_shared(spark, p)) for p in paths]))
    if key not in _DERIVED:
        _DERIVED[key] = build(scratch_path(spark, kind))
    return _DERIVED[key]
