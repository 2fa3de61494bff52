"""File sources and sinks: directory listings, text documents, JSON histories
and evaluation files, chunk files."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.mime import path_name
from quarry.operators.history import has_function_item
from quarry.session import open_shared

MESSAGE_SCHEMA = T.StructType([
    T.StructField("role", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    T.StructField("has_function_item", T.BooleanType()),
    T.StructField("items", T.ArrayType(T.StructType([
        T.StructField("kind", T.StringType()), T.StructField("text", T.StringType())]))),
])

EVAL_QUERY_SCHEMA = T.StructType([
    T.StructField("QueryId", T.IntegerType()),
    T.StructField("QueryText", T.StringType()),
])

RETURNED_DOC = T.StructType([
    T.StructField("Rank", T.IntegerType()),
    T.StructField("DocumentId", T.StringType()),
    T.StructField("ExtractedText", T.StringType()),
    T.StructField("Score", T.FloatType()),
    T.StructField("IsRelevant", T.IntegerType()),
])

EVAL_RESULT_SCHEMA = T.StructType([
    T.StructField("QueryId", T.IntegerType()),
    T.StructField("Query", T.StringType()),
    T.StructField("Results", T.ArrayType(RETURNED_DOC)),
])


def list_source_files(spark: SparkSession, directory: str, recursive: bool = False) -> DataFrame:
    """``(path, name, length, modificationTime)`` of the regular files of a
    folder, dot-files dropped; content is not read (column pruning keeps the
    binary column out of the scan)."""
    df = (spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
          .load(directory))
    return (df.select("path", path_name(F.col("path")).alias("name"), "length", "modificationTime")
            .where(~F.col("name").startswith(".")))


def read_text_documents(spark: SparkSession, paths, recursive: bool = False) -> DataFrame:
    """``(path, text)``: each ``.txt`` file as one document (whole text);
    other suffixes are rejected, as the plain-text loader does.  With ``recursive`` the paths
    are folders whose ``.txt`` files are read, at any depth: a folder is listed at once, where
    a pattern would be a root path (and a listing task) for every file."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    reader = spark.read
    if recursive:
        reader = reader.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt")
    elif bad := [p for p in paths if not p.lower().endswith(".txt")]:
        raise ValueError(f"not a .txt file: {bad[0]}")
    return (reader.text(paths, wholetext=True)
            .select(F.input_file_name().alias("path"), F.col("value").alias("text")))


def folder_name(c: Column) -> Column:
    """A text as part of a file name that paths and URIs write alike (``%`` of a URL as ``=``)."""
    return F.replace(F.url_encode(c), F.lit("%"), F.lit("="))


def from_folder_name(c: Column) -> Column:
    return F.url_decode(F.replace(c, F.lit("="), F.lit("%")))


def write_text_files(lines: DataFrame, path: str, *, file_col: str = "file", order_by: str = "doc_id", value_col: str = "value") -> int:
    """Rows as text files below ``path``, one for every ``file_col`` (a relative path), a line a
    row in the order of ``order_by``; the number of files.  A task writes its files itself under
    a dot-name and moves each into place, so a repeated task writes the same file again, and no
    folder or commit of one file each is left to the driver."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, done, name, out, held = set(), 0, None, None, ""

        def close() -> None:
            out.close()
            store.move(held, f"{base}/{name}")

        store, base = open_shared(path.rstrip("/"))
        for batch in batches:
            for file, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if file != name:
                    if out is not None:
                        close()
                    name, folder = file, f"{base}/{file}".rpartition("/")[0]
                    if folder not in made:
                        store.create_dir(folder, recursive=True)
                        made.add(folder)
                    held, done = f"{folder}/.{uuid.uuid4().hex}", done + 1
                    out = store.open_output_stream(held)
                out.write(value + b"\n")
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([done], pa.int64())], ["n"])

    dealt = lines.select(file_col, F.col(value_col).cast("binary").alias("value"), order_by).repartition(file_col)
    rows = dealt.sortWithinPartitions(file_col, order_by).select(file_col, "value")
    return rows.mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def read_history(spark: SparkSession, paths) -> DataFrame:
    """Messages ``(conv_id, turn, role, text, metadata, has_function_item)``
    from JSON-array history files; the flag is the file's, or else derived from the message's
    ``items``.  One file is one conversation, named by its
    ``conv_id=`` folder (as ``write_history`` lays them out) or else by its path."""
    schema = T.StructType([*MESSAGE_SCHEMA.fields, T.StructField("conv_id", T.StringType())])
    raw = spark.read.schema(schema).json(paths, multiLine=True)
    # a file is read by one task in order, so ids are consecutive inside it
    raw = raw.withColumn("file", F.input_file_name()).withColumn("mid", F.monotonically_increasing_id())
    first = raw.groupBy("file").agg(F.min("mid").alias("first"))
    return (raw.join(first, "file").withColumn("turn", F.col("mid") - F.col("first"))
            .select(F.coalesce("conv_id", "file").alias("conv_id"), "turn", "role", F.col("content").alias("text"),
                    F.coalesce("metadata", F.create_map().cast("map<string,string>")).alias("metadata"),
                    F.coalesce("has_function_item", has_function_item("items")).alias("has_function_item")))


def write_history(messages: DataFrame, path: str) -> None:
    """One JSON array per conversation, in a folder ``conv_id=<id>``; messages in turn
    order with role, content, metadata and the function flag.  ``turn`` itself is the
    place in the array, so gaps close."""
    for name, kind in (("metadata", "map<string,string>"), ("has_function_item", "boolean")):
        if name not in messages.columns:
            messages = messages.withColumn(name, F.lit(None).cast(kind))
    if "items" not in messages.columns:
        messages = messages.withColumn("items", F.lit(None).cast(MESSAGE_SCHEMA["items"].dataType))
    message = F.struct("role", F.col("text").alias("content"), "metadata", "has_function_item", "items")
    rows = messages.select("conv_id", F.struct(F.col("turn").alias("t"), F.to_json(message).alias("m")).alias("row"))
    arrays = rows.groupBy("conv_id").agg(F.to_json(F.transform(
        F.array_sort(F.collect_list("row")),
        lambda x: F.from_json(x["m"], MESSAGE_SCHEMA))).alias("value"))
    arrays.repartition("conv_id").write.partitionBy("conv_id").mode("errorifexists").text(path)


def history_file_stem(custom: str | None = None):
    """``ChatHistory-dd-MM-yy-HHmm.json`` or a custom name with ``.json`` added
    when it has no extension (a Column, evaluated at run time)."""
    if custom:
        return F.lit(custom if "." in custom.rsplit("/", 1)[-1] else custom + ".json")
    return F.concat(F.lit("ChatHistory-"), F.date_format(F.current_timestamp(), "dd-MM-yy-HHmm"),
                    F.lit(".json"))


def read_eval_queries(spark: SparkSession, path: str) -> DataFrame:
    """``(query_id, query_text)``; a missing file gives an empty table."""
    empty = spark.createDataFrame([], "query_id int, query_text string")
    try:
        df = spark.read.schema(EVAL_QUERY_SCHEMA).json(path, multiLine=True)
        return df.select(F.col("QueryId").alias("query_id"), F.col("QueryText").alias("query_text"))
    except Exception as e:  # noqa: BLE001 - path does not exist
        if "PATH_NOT_FOUND" in str(e) or "does not exist" in str(e):
            return empty
        raise


def nest_eval_results(flat: DataFrame) -> DataFrame:
    """Flat ``(query_id, query, rank, document_id, extracted_text, score,
    is_relevant)`` -> nested ``QueryId, Query, Results[]`` rows."""
    doc = F.struct(F.col("rank").cast("int").alias("Rank"), F.col("document_id").alias("DocumentId"),
                   F.col("extracted_text").alias("ExtractedText"), F.col("score").cast("float").alias("Score"),
                   F.col("is_relevant").cast("int").alias("IsRelevant"))
    return (flat.groupBy("query_id", "query")
            .agg(F.array_sort(F.collect_list(F.struct(F.col("rank").alias("k"), doc.alias("d")))).alias("r"))
            .select(F.col("query_id").cast("int").alias("QueryId"), F.col("query").alias("Query"),
                    F.transform("r", lambda x: x["d"]).alias("Results")))


def write_eval_results(nested: DataFrame, base: str, run_id: str) -> str:
    """Write under ``base/run_id``; never overwrites an existing run (error),
    NULL labels are omitted from the JSON."""
    path = f"{base.rstrip('/')}/{run_id}"
    nested.write.mode("errorifexists").option("ignoreNullFields", "true").json(path)
    return path


CHUNK_BUCKETS = 64  # folders of a chunk store


def write_chunks(chunks: DataFrame, path: str, parents: DataFrame | None = None) -> None:
    """Add chunk rows to the store at ``path``, in hash buckets of their parent document.
    Chunks of other parents stay; a parent written again replaces its former chunks
    (``read_chunks`` takes the latest write of each parent).  ``parents (parent_id)`` names
    what was chunked, so that a parent whose text became empty loses its chunks."""
    spark = chunks.sparkSession
    at = spark.sql("SELECT current_timestamp()").first()[0]  # one time for the whole write
    stamp = lambda df: df.withColumns({
        "bucket": F.pmod(F.xxhash64("parent_id"), F.lit(CHUNK_BUCKETS)).cast("int"), "written_at": F.lit(at).cast("timestamp")})
    named = chunks.select("parent_id") if parents is None else parents.select("parent_id").unionByName(chunks.select("parent_id"))
    stamp(chunks).repartition("bucket").write.mode("append").partitionBy("bucket").parquet(path)
    # the log comes second: until it is there, readers see the former chunks
    stamp(named.distinct()).repartition("bucket").write.mode("append").partitionBy("bucket").parquet(f"{path.rstrip('/')}-parents")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunks of every parent's latest write, by the narrow log of writes."""
    log = spark.read.parquet(f"{path.rstrip('/')}-parents")
    latest = log.groupBy("parent_id").agg(F.max("written_at").alias("written_at"))
    return spark.read.parquet(path).join(latest, ["parent_id", "written_at"]).drop("bucket", "written_at")
