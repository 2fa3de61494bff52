"""Set-based record maintenance: list, upsert, delete (DataFrame in, DataFrame out)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.tags import DOCUMENT_TAG, tags_filter
from quarry.functions.text import strip_nul
from quarry.operators.ordering import after_key, key_at_rank, upto_key
from quarry.session import scratch_path

RECORD_SCHEMA = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("embedding", T.ArrayType(T.FloatType()), True),
    T.StructField("tags", T.ArrayType(T.StringType()), False),
    T.StructField("content", T.StringType(), False),
    T.StructField("payload", T.StringType(), False),
])

RECORD_COLUMNS = [f.name for f in RECORD_SCHEMA.fields]


def project(records: DataFrame, with_embeddings: bool = False) -> DataFrame:
    """The two projections of a record: without or with the embedding."""
    cols = RECORD_COLUMNS if with_embeddings else [c for c in RECORD_COLUMNS if c != "embedding"]
    return records.select(*cols)


NEAR = 10_000  # an offset up to which a page is a top-k


def list_records(records: DataFrame, filters=None, limit: int = 1, offset: int = 0,
                 order_by: str | Column = "id", with_embeddings: bool = False, near: int = NEAR) -> DataFrame:
    """Filtered page of records ordered by ``order_by`` (then id).
    ``limit <= 0`` means no limit.  A page within ``near`` rows of the start is a top-k.
    Further pages find the key before them, and that at their end, by rank selection over
    the keys alone, which are stored once; only the rows between them are read whole and
    sorted, so no task holds the rows before a page and no other row is moved."""
    out = records.where(tags_filter(filters))
    named = isinstance(order_by, str) and order_by == "id"
    if not named:
        out = out.withColumn("__key", F.col(order_by) if isinstance(order_by, str) else order_by)
    keys = ["id"] if named else ["__key", "id"]
    names = project(out, with_embeddings).columns
    if (0 < limit <= near and offset + limit <= near) or (limit <= 0 and offset <= 0):
        page = out.orderBy(*keys)
        page = page.offset(offset) if offset > 0 else page
        return (page.limit(limit) if limit > 0 else page).select(*names)
    path = scratch_path(records.sparkSession, "page-keys")
    narrow = out.select(*keys)
    narrow.write.parquet(path)
    narrow = records.sparkSession.read.schema(narrow.schema).parquet(path)
    page = out
    if offset > 0:
        before = key_at_rank(narrow, keys, offset - 1)
        if before is None:
            return out.limit(0).select(*names)
        page, narrow = after_key(page, keys, before), after_key(narrow, keys, before)
    last = key_at_rank(narrow, keys, limit - 1) if limit > 0 else None
    page = (page if last is None else upto_key(page, keys, last)).orderBy(*keys)
    return (page.limit(limit) if 0 < limit <= near else page).select(*names)


def document_id(tags: str | Column = "tags") -> Column:
    """The document id held in the reserved ``__document_id:<id>`` tag; NULL without one."""
    t = F.col(tags) if isinstance(tags, str) else tags
    prefix = DOCUMENT_TAG + ":"
    hit = F.filter(t, lambda x: x.startswith(prefix))
    return F.substring(F.try_element_at(hit, F.lit(1)), len(prefix) + 1, 1 << 30)


def records_of_documents(records: DataFrame, documents: DataFrame) -> DataFrame:
    """Records whose document id is in ``documents.document_id`` (semi-join)."""
    return (records.withColumn("__doc", document_id())
            .join(documents.select(F.col("document_id").alias("__doc")), "__doc", "left_semi")
            .drop("__doc"))


def with_defaults(records: DataFrame) -> DataFrame:
    """Stored form: NUL removed from content; NULL payload/content/tags get
    ``{}`` / ``''`` / ``[]``."""
    return records.select(
        "id", "embedding",
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
        F.coalesce(strip_nul("content"), F.lit("")).alias("content"),
        F.coalesce("payload", F.lit("{}")).alias("payload"),
        *[c for c in records.columns if c not in RECORD_COLUMNS])


def latest_per_id(incoming: DataFrame, seq: str | None = None) -> DataFrame:
    """One row per id; with a sequence column the highest one wins.  Without
    one the choice is still deterministic (the greatest row), so a retried
    task after a lost executor picks the same row."""
    if seq is None:
        cols = [c for c in incoming.columns if c != "id"]
        return (incoming.groupBy("id").agg(F.max(F.struct(*cols)).alias("__r"))
                .select("id", *[F.col("__r")[c].alias(c) for c in cols]))
    w = Window.partitionBy("id").orderBy(F.col(seq).desc())
    return (incoming.withColumn("__rn", F.row_number().over(w)).where("__rn = 1")
            .drop("__rn", seq))


def upsert(existing: DataFrame, incoming: DataFrame, seq: str | None = None) -> DataFrame:
    """Insert new ids, fully replace the non-key columns of existing ones.

    One shuffle on ``id`` for the anti-join; the result is the next version of
    the table (write it to a new location, never over the one being read)."""
    new = with_defaults(latest_per_id(incoming, seq)).select(*existing.columns)
    kept = existing.join(new.select("id"), "id", "left_anti")
    return kept.unionByName(new)


def delete_records(records: DataFrame, ids: DataFrame) -> DataFrame:
    """Drop the records whose id is in ``ids.id`` (anti-join)."""
    return records.join(ids.select("id"), "id", "left_anti")


def delete_documents(records: DataFrame, documents: DataFrame) -> DataFrame:
    """Drop every record of the given documents (``documents.document_id``)."""
    return (records.withColumn("__doc", document_id())
            .join(documents.select(F.col("document_id").alias("__doc")), "__doc", "left_anti")
            .drop("__doc"))


def delete_document(records: DataFrame, doc_id: str) -> DataFrame:
    """Drop the records of one document."""
    return records.where(~F.array_contains("tags", f"{DOCUMENT_TAG}:{doc_id}"))
