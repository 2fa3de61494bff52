"""Continuous ingestion: files arriving in a folder -> chunk records, upserted.

``readStream`` over the source folder (checkpointed file source, so every file
is read once) -> per micro-batch: one row per document, chunking, chunk
records -> written to ``<target>/epoch=<id>`` with overwrite, the list
of the documents read to ``<target>-parents/epoch=<id>``.  A replayed
epoch (after a lost executor or driver restart) rewrites the same folders, so
the sink is exactly-once.  Readers merge on read: of every document the chunks
of its latest epoch count, which makes re-imported documents an upsert.

Keyed state of ``start_ingest`` holds the content hash of every document seen within ``seen_for`` (a hash and a
time each; a watermark over arrival times evicts the rest): a document that arrives again
unchanged, in whatever file, is not chunked again, one that changed, or changed back, is.
A document that comes back after its eviction is chunked once more, into the same ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from quarry.operators.chunking import chunk_records, fixed_window_chunks
from quarry.session import has_folder


def _chunk_batch(batch: DataFrame) -> DataFrame:
    """Chunk records; of rows that repeat a document the same one is taken every time."""
    first = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text")
    docs = batch.withColumn("__rn", F.row_number().over(first)).where("__rn = 1").drop("__rn")
    return chunk_records(fixed_window_chunks(docs))


SEEN_FOR = "30 days"  # how long an unchanged document is recognised


def unseen(stream: DataFrame, key: str, content: str, seen_for: str) -> DataFrame:
    """Rows of a stream whose document is new or changed: per document and micro-batch at
    most one, whose content differs from the last one seen."""
    columns = {f.name: f.dataType for f in stream.schema.fields}
    whole_numbers = {c for c, t in columns.items() if isinstance(t, (T.LongType, T.IntegerType, T.ShortType, T.ByteType))}
    # whole numbers travel as text: beside NULL, pandas would make them floats
    rows = stream.select(
        F.coalesce(F.col(key).cast("string"), F.lit("")).alias("__key"),
        F.sha2(F.coalesce(F.col(content).cast("binary"), F.lit(b"")), 256).alias("__hash"), F.current_timestamp().alias("__arrived"),
        *[F.col(c).cast("string").alias(c) if c in whole_numbers else F.col(c) for c in columns])
    schema = T.StructType([T.StructField(c, T.StringType() if c in whole_numbers else t) for c, t in columns.items()])

    def pick(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        best, arrived = None, 0
        for frame in frames:
            arrived = max(arrived, int(frame["__arrived"].max().timestamp() * 1000))
            changed = frame[frame["__hash"] != last]
            if len(changed):
                row = changed.sort_values("__hash", kind="stable").head(1)
                if best is None or row["__hash"].iloc[0] < best["__hash"].iloc[0]:
                    best = row
        state.update((last if best is None else best["__hash"].iloc[0],))
        state.setTimeoutTimestamp(arrived + 1)  # arrival times never lie before the watermark
        if best is not None:
            yield best[list(columns)]

    picked = rows.withWatermark("__arrived", seen_for).groupBy("__key").applyInPandasWithState(
        pick, schema, "last string", "append", "EventTimeTimeout")
    return picked.select(*[F.col(c).cast(columns[c]).alias(c) if c in whole_numbers else F.col(c) for c in columns])


def _write_epoch(chunks: DataFrame, parents: DataFrame, target_dir: str, epoch_id: int) -> None:
    """Chunks of the epoch and the parents it read, those without a chunk included."""
    base = target_dir.rstrip("/")
    chunks.write.mode("overwrite").parquet(f"{base}/epoch={epoch_id}")
    parents.distinct().write.mode("overwrite").parquet(f"{base}-parents/epoch={epoch_id}")


def _started(stream: DataFrame, write, checkpoint_dir: str, available_now: bool) -> StreamingQuery:
    """``write(batch, epoch)`` for every micro-batch that has rows (and the first one)."""
    def run(batch: DataFrame, epoch_id: int) -> None:
        batch = batch.persist()  # several jobs read it; its state is computed once
        try:
            if epoch_id == 0 or not batch.isEmpty():
                write(batch, epoch_id)
        finally:
            batch.unpersist()

    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint_dir)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")).start()


def _binary_files(spark: SparkSession, source_dir: str, max_files_per_trigger: int) -> DataFrame:
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    return (spark.readStream.format("binaryFile").schema(schema)
            .option("maxFilesPerTrigger", max_files_per_trigger).load(source_dir))


def start_ingest(spark: SparkSession, source_dir: str, target_dir: str, checkpoint_dir: str, *,
                 file_pattern: str = "documents.parquet", max_files_per_trigger: int = 1,
                 available_now: bool = True, chunker=_chunk_batch, seen_for: str = SEEN_FOR) -> StreamingQuery:
    """``file_pattern`` names files of ``source_dir``, or folders of it whose files are read (a
    table that was written in parts)."""
    found = f"{source_dir.rstrip('/')}/{file_pattern}"
    schema = spark.read.parquet(found).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
    # a filter of names would drop the files of a folder, whatever the folder's name
    stream = (reader.parquet(found) if has_folder(spark, found) else
              reader.option("pathGlobFilter", file_pattern).parquet(source_dir))

    def write(batch: DataFrame, epoch_id: int) -> None:
        _write_epoch(chunker(batch), batch.select(F.col("doc_id").cast("string").alias("parent_id")),
                     target_dir, epoch_id)

    return _started(unseen(stream, "doc_id", "text", seen_for), write, checkpoint_dir, available_now)


def start_file_ingest(spark: SparkSession, source_dir: str, target_dir: str, checkpoint_dir: str, *,
                      max_files_per_trigger: int = 100, available_now: bool = True,
                      strict: bool = False) -> StreamingQuery:
    """Files dropped into ``source_dir`` (any mix of types) -> chunk records,
    routed per file by MIME type; same exactly-once epoch sink.  The file source reads
    every path once, so no state of documents is kept here."""
    from quarry.operators.loading import chunk_files

    def write(batch: DataFrame, epoch_id: int) -> None:
        _write_epoch(chunk_files(batch, strict=strict), batch.select(F.col("path").alias("parent_id")),
                     target_dir, epoch_id)

    return _started(_binary_files(spark, source_dir, max_files_per_trigger), write, checkpoint_dir, available_now)


def start_file_import(spark: SparkSession, catalog, index: str, source_dir: str, checkpoint_dir: str, *,
                      max_files_per_trigger: int = 100, available_now: bool = True, **options) -> StreamingQuery:
    """Files dropped into ``source_dir`` -> records upserted into an index, per micro-batch
    (a replayed batch upserts the same ids)."""
    from quarry.operators.loading import import_files

    stream = _binary_files(spark, source_dir, max_files_per_trigger)
    return _started(stream, lambda batch, _: import_files(catalog, index, batch, **options), checkpoint_dir, available_now)


def read_merged(spark: SparkSession, target_dir: str) -> DataFrame:
    """Current table: of every parent the chunks of its latest epoch only, so a document
    that came again shorter (or empty) leaves nothing behind.  The latest epoch comes from
    the narrow parent log; chunk texts move in one join at most."""
    base = target_dir.rstrip("/")
    latest = spark.read.parquet(f"{base}-parents").groupBy("parent_id").agg(F.max("epoch").alias("epoch"))
    return spark.read.parquet(base).join(latest, ["parent_id", "epoch"]).drop("epoch")


def compact(spark: SparkSession, target_dir: str, new_dir: str) -> None:
    """Write the current table as epoch -1 of a new log (older than any later epoch)."""
    merged = read_merged(spark, target_dir)
    _write_epoch(merged, merged.select("parent_id"), new_dir, -1)
