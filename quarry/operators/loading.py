"""Files -> chunk records in one job: list, route every row by its MIME type,
decode, chunk with the loader of that type, describe the chunks.

Plain text goes through the recursive splitter, Markdown through the heading
splitter; types whose parsers are not built here (PDF, Word, PowerPoint,
Excel) are returned by ``unsupported_files`` instead of being read.  With
``strict=True`` an unknown suffix fails the job, as the loader's strict
lookup does."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.mime import mime_from_name_strict, path_name
from quarry.functions.tags import document_tag
from quarry.operators.chunking import (CHUNK_OVERLAP, CHUNK_SIZE, chunk_records,
                                       markdown_sections, recursive_chunks)
from quarry.operators.routing import route_files, skip_imported
from quarry.operators.store import records_of_documents

BUILT_LOADERS = ("text", "markdown")


def _routed(files: DataFrame, strict: bool) -> DataFrame:
    if strict:
        # a filter, not a projected column: an unused column would be pruned
        # by the optimiser and the check would never run
        files = files.where(mime_from_name_strict(F.col("path")).isNotNull())
    return route_files(files)


def unsupported_files(files: DataFrame, strict: bool = False) -> DataFrame:
    """Rows that are skipped: unsupported type or a loader not built here."""
    r = _routed(files, strict)
    return r.where(~F.col("supported") | ~F.col("loader").isin(*BUILT_LOADERS))


def chunk_files(files: DataFrame, *, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP,
                strict: bool = False, tags: list[str] | None = None,
                ready: DataFrame | None = None, text_chunks=recursive_chunks) -> DataFrame:
    """Chunk records of ``files (path, content binary)`` - e.g. the output of
    ``spark.read.format("binaryFile")``.  ``ready (document_id)`` lists
    documents already imported (the path is the document id); they are
    skipped with an anti-join before any content is decoded.  Every chunk carries the
    tag of its document beside ``tags``; ``text_chunks`` splits plain text."""
    r = _routed(files, strict).where(F.col("loader").isin(*BUILT_LOADERS))
    r = r.withColumn("document_id", F.col("path"))
    if ready is not None:
        r = skip_imported(r, ready)
    docs = r.select("path", "loader", F.decode("content", "UTF-8").alias("text"))
    text = text_chunks(docs.where(F.col("loader") == "text"), size, overlap, key="path").select(
        "path", "partition_number", "text")
    md = (markdown_sections(docs.where(F.col("loader") == "markdown"), key="path")
          .select("path", F.col("section_no").alias("partition_number"), F.col("content").alias("text")))
    chunks = text.unionByName(md)
    tag_col = F.array(F.concat(F.lit(document_tag("")), F.col("path")), *[F.lit(t) for t in (tags or [])])
    return chunk_records(chunks, parent="path", name=path_name(F.col("path")), tags=tag_col)


def file_records(files: DataFrame, *, embed=None, **options) -> DataFrame:
    """Searchable records of ``files``: chunks with their document tag, the file name and
    source path in the payload, and ``embed(content)`` (a Column builder) as vector, NULL
    without one.  ``options`` go to ``chunk_files``."""
    chunks = chunk_files(files, **options)
    return chunks.select(
        "id", (embed(F.col("text")) if embed else F.lit(None)).cast("array<float>").alias("embedding"),
        "tags", F.col("text").alias("content"),
        F.to_json(F.struct(F.col("name").alias("file"), F.col("parent_id").alias("source"), "partition_number",
                           "content_sha256")).alias("payload"))


def import_files(catalog, index: str, files: DataFrame, **options) -> None:
    """Chunk, embed and upsert files into an index; a file imported again replaces its
    former chunks, in one step: no reader sees chunks of both versions.
    ``catalog.delete_documents`` by path removes a file."""
    incoming = file_records(files, **options)
    catalog.create(index)
    paths = files.select(F.col("path").alias("document_id")).distinct()
    former = records_of_documents(catalog.read(index, with_embeddings=False), paths).select("id")
    catalog.apply(index, upserts=incoming, deletes=former)
