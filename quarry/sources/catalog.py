"""Indexes: one record table per collection, in hash buckets under the shared folder.

An index is a folder of bucket folders and a manifest per version that names the folder of
every bucket:

    data/<write>/bucket=<b>/*.parquet    records of one bucket, sorted by id
    manifest/<version>/*.parquet         (bucket, folder below the index, version)
    leases/<name>                        versions that a reader holds

The session catalog holds a table ``<prefix><normalised name>`` whose location is the current
manifest, so a new version takes effect by one catalog update: readers see the old version or
the new one, never a mixture, whatever a change consisted of.

``apply`` is the one way to change an index: upserts and deletes together.  Only buckets that
hold a changed id are read, merged and written again (one shuffle of their rows by range of
bucket and id); all other buckets keep their folders.  After a change, folders that no kept
version names are removed: the current version, ``keep`` versions before it, and versions
under a lease (``snapshot``) are kept.

One writer per index at a time: a version that changed since it was read raises
``IndexChanged``.  A failed change leaves the index as it was; its folder is removed by the
next change.

Defined cases: reading or deleting from a missing index yields nothing; changing it raises
``IndexNotFound``; an id that is both upserted and deleted is upserted; deleting unknown ids
writes the buckets they would be in; ids that repeat in one change are settled by
``latest_per_id``; a NULL id raises.
"""

from __future__ import annotations

import contextlib
import re
import time
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.operators.store import RECORD_SCHEMA, latest_per_id, records_of_documents, with_defaults
from quarry.session import delete_shared, list_shared, scratch_path, shared_dir, touch_shared

DEFAULT_PREFIX = "rag-"  # fixed value: default table-name prefix of an index
BUCKETS, KEEP, LEASE_HOURS = 64, 1, 24
MANIFEST = "bucket int, folder string, version string"


class IndexNotFound(LookupError):
    pass


class IndexChanged(RuntimeError):
    pass


def normalize_name(name: str | None, blank_ok: bool = False) -> str:
    """trim, lower-case, each of whitespace | \\ / . _ : becomes '-'."""
    if name is None or not name.strip():
        if blank_ok:
            return ""
        raise ValueError("index name is empty")
    return re.sub(r"[\s|\\/._:]", "-", name.strip().lower())


class IndexCatalog:
    def __init__(self, spark: SparkSession, prefix: str = DEFAULT_PREFIX, database: str = "default",
                 root: str | None = None, buckets: int = BUCKETS, keep: int = KEEP):
        """``buckets`` holds for indexes made here (about a gigabyte to a bucket is right);
        ``keep`` versions before the current one stay readable."""
        self.spark = spark
        self.buckets, self.keep = buckets, keep
        self.prefix = normalize_name(prefix, blank_ok=True)
        self.database = database
        self.root = (root or f"{shared_dir(spark)}/quarry-indexes").rstrip("/")

    # Normalised names use '-', which the session catalog does not accept in
    # table identifiers; normalised names never contain '_', so '-' <-> '_' is
    # a lossless mapping between index names and table names.
    def _table_name(self, index: str) -> str:
        return f"{self.prefix}{normalize_name(index)}".replace("-", "_")

    def table(self, index: str) -> str:
        """The catalog table of the current manifest."""
        return f"`{self.database}`.`{self._table_name(index)}`"

    def folder(self, index: str) -> str:
        """The folder of an index: where its manifest lies, or a new one below the root."""
        if self.exists(index):
            return self._location(index).rsplit("/", 2)[0]
        return f"{self.root}/{self.prefix}{normalize_name(index)}"

    def exists(self, index: str) -> bool:
        return self.spark.catalog.tableExists(self.table(index))

    # -- versions ------------------------------------------------------------------

    def _property(self, index: str, name: str) -> int | None:
        rows = self.spark.sql(f"SHOW TBLPROPERTIES {self.table(index)}").collect()
        return next((int(r["value"]) for r in rows if r["key"] == f"quarry.{name}"), None)

    def _location(self, index: str) -> str:
        rows = self.spark.sql(f"DESCRIBE TABLE EXTENDED {self.table(index)}").collect()
        return next(r["data_type"] for r in rows if r["col_name"] == "Location").rstrip("/")

    def version(self, index: str) -> str:
        return self._location(index).rsplit("/", 1)[1]

    def _manifest(self, index: str, version: str) -> dict[int, str]:
        """Folder of every bucket that holds records: one small row a bucket."""
        rows = self.spark.read.schema(MANIFEST).parquet(f"{self.folder(index)}/manifest/{version}").collect()
        return {r.bucket: r.folder for r in rows}

    def _write_manifest(self, index: str, folders: dict[int, str]) -> str:
        version = uuid.uuid4().hex
        rows = [(b, f, version) for b, f in sorted(folders.items())]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.parquet(f"{self.folder(index)}/manifest/{version}")
        return version

    def _records(self, index: str, folders) -> DataFrame:
        base = self.folder(index)
        paths = [f"{base}/{f}" for f in sorted(folders)]
        if not paths:
            return self.spark.createDataFrame([], RECORD_SCHEMA)
        return self.spark.read.schema(RECORD_SCHEMA).parquet(*paths)

    def create(self, index: str, vector_size: int | None = None) -> None:
        """Create an empty index unless it exists.  With ``vector_size`` an upsert of a
        vector of another size fails."""
        if self.exists(index):
            return
        version = self._write_manifest(index, {})
        sizes = f", 'quarry.vector_size' = '{int(vector_size)}'" if vector_size else ""
        self.spark.sql(f"CREATE TABLE {self.table(index)} ({MANIFEST}) USING parquet "
                       f"LOCATION '{self.folder(index)}/manifest/{version}' "
                       f"TBLPROPERTIES ('quarry.buckets' = '{int(self.buckets)}'{sizes})")

    def vector_size(self, index: str) -> int | None:
        return self._property(index, "vector_size")

    def list(self) -> list[str]:
        """Index names (prefix removed) of the tables whose name starts with
        the prefix, compared case-insensitively."""
        pre = self.prefix.replace("-", "_").lower()
        return sorted(t.name[len(pre):].replace("_", "-") for t in self.spark.catalog.listTables(self.database)
                      if t.name.lower().startswith(pre) and not t.isTemporary)

    def drop(self, index: str) -> None:
        """Remove the index and all files of all its versions."""
        if not self.exists(index):
            return
        base = self.folder(index)
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table(index)}")
        for part in ("data", "manifest", "leases"):
            delete_shared(self.spark, f"{base}/{part}")

    def drop_all(self) -> None:
        for name in self.list():
            self.drop(name)

    # -- reading -------------------------------------------------------------------

    def read(self, index: str, with_embeddings: bool = True) -> DataFrame:
        """The current version.  It stays readable for ``keep`` further changes; hold it with
        ``snapshot`` where changes may overtake the reader."""
        if not self.exists(index):
            df = self.spark.createDataFrame([], RECORD_SCHEMA)
        else:
            df = self._records(index, self._manifest(index, self.version(index)).values())
        return df if with_embeddings else df.drop("embedding")

    @contextlib.contextmanager
    def snapshot(self, index: str) -> Iterator[DataFrame]:
        """The current version, kept from removal while the block runs (at most
        ``LEASE_HOURS``, so that a lost reader does not keep it for ever)."""
        if not self.exists(index):
            raise IndexNotFound(index)
        while True:
            version = self.version(index)
            lease = f"{self.folder(index)}/leases/{version}-{int(time.time())}-{uuid.uuid4().hex}"
            touch_shared(self.spark, lease)
            if self.version(index) == version:  # else a change may have removed it before the lease
                break
            delete_shared(self.spark, lease)
        try:
            yield self._records(index, self._manifest(index, version).values())
        finally:
            delete_shared(self.spark, lease)

    # -- changing ------------------------------------------------------------------

    def _checked(self, index: str, incoming: DataFrame) -> DataFrame:
        incoming = incoming.withColumn("id", F.when(F.col("id").isNull(), F.raise_error(F.lit("a record without an id")))
                                       .otherwise(F.col("id").cast("string")))
        if size := self.vector_size(index):
            wrong = F.col("embedding").isNotNull() & (F.size("embedding") != size)
            incoming = incoming.withColumn("embedding", F.when(wrong, F.raise_error(F.concat(
                F.lit(f"index vectors have {size} values; record "), "id"))).otherwise(F.col("embedding")))
        return incoming

    def apply(self, index: str, upserts: DataFrame | None = None, deletes: DataFrame | None = None,
              seq: str | None = None) -> None:
        """Insert or replace the records of ``upserts`` and remove the ids of ``deletes`` in
        one step."""
        if not self.exists(index):
            raise IndexNotFound(index)
        fields = {f.name: f.dataType for f in RECORD_SCHEMA.fields}
        changes = []
        if upserts is not None:
            rows = with_defaults(latest_per_id(self._checked(index, upserts), seq))
            changes.append(rows.select(*[F.col(c).cast(t).alias(c) for c, t in fields.items()], F.lit(0).alias("kind")))
        if deletes is not None:
            gone = deletes.select(F.col("id").cast("string")).where("id IS NOT NULL").distinct()
            changes.append(gone.select("id", *[F.lit(None).cast(t).alias(c) for c, t in fields.items() if c != "id"],
                                       F.lit(1).alias("kind")))
        if not changes:
            return
        base, n = self.folder(index), self._property(index, "buckets")
        version = self.version(index)
        folders = self._manifest(index, version)
        bucket = F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
        staged = scratch_path(self.spark, "index-change")
        all_changes = changes[0] if len(changes) == 1 else changes[0].unionByName(changes[1])
        all_changes.withColumn("bucket", bucket).write.parquet(staged)
        staged_rows = self.spark.read.parquet(staged)
        touched = {r.bucket for r in staged_rows.select("bucket").distinct().collect()}  # at most one row a bucket
        if touched:
            old = self._records(index, [folders[b] for b in touched if b in folders])
            rows = staged_rows.unionByName(old.select(*fields, F.lit(2).alias("kind"), bucket.alias("bucket")))
            # the window needs no exchange of its own: ranges of (bucket, id) hold all rows of an id
            first = Window.partitionBy("bucket", "id").orderBy("kind")
            rows = (rows.repartitionByRange("bucket", "id").withColumn("place", F.row_number().over(first))
                    .where("place = 1 AND kind <> 1").drop("place", "kind").sortWithinPartitions("bucket", "id"))
            data = f"data/{uuid.uuid4().hex}"
            rows.write.partitionBy("bucket").parquet(f"{base}/{data}")
            written = {int(name.split("=")[1]) for name in list_shared(self.spark, f"{base}/{data}") if name.startswith("bucket=")}
            folders = {b: f for b, f in folders.items() if b not in touched} | {b: f"{data}/bucket={b}" for b in written}
            following = self._write_manifest(index, folders)
            if self.version(index) != version:
                raise IndexChanged(index)
            self.spark.sql(f"ALTER TABLE {self.table(index)} SET LOCATION '{base}/manifest/{following}'")
            self.spark.catalog.refreshTable(self.table(index))
            self.remove_old(index, version)
        delete_shared(self.spark, staged)

    def upsert(self, index: str, incoming: DataFrame, seq: str | None = None) -> None:
        self.apply(index, upserts=incoming, seq=seq)

    def delete(self, index: str, ids: DataFrame) -> None:
        if self.exists(index):
            self.apply(index, deletes=ids)

    def delete_documents(self, index: str, documents: DataFrame) -> None:
        """Remove every record of ``documents (document_id)``."""
        if self.exists(index):
            self.apply(index, deletes=records_of_documents(self.read(index, with_embeddings=False), documents).select("id"))

    def remove_old(self, index: str, before: str | None = None) -> None:
        """Remove the files of versions that are neither current, nor among the ``keep``
        latest before it, nor leased."""
        base, current = self.folder(index), self.version(index)
        manifests = list_shared(self.spark, f"{base}/manifest")
        older = [name for name, _ in sorted(manifests.items(), key=lambda x: (x[0] == before, x[1]), reverse=True) if name != current]
        now = time.time()
        leases = {name.split("-")[0]: int(name.split("-")[1]) for name in list_shared(self.spark, f"{base}/leases")}
        leased = {v for v, at in leases.items() if now - at < 3600 * LEASE_HOURS}
        kept = {current, *older[:self.keep], *(leased & set(manifests))}
        used = {f for v in kept for f in self._manifest(index, v).values()}
        for write in list_shared(self.spark, f"{base}/data"):
            inside = [name for name in list_shared(self.spark, f"{base}/data/{write}") if name.startswith("bucket=")]
            stale = [name for name in inside if f"data/{write}/{name}" not in used]
            if len(stale) == len(inside):
                delete_shared(self.spark, f"{base}/data/{write}")
                continue
            for name in stale:
                delete_shared(self.spark, f"{base}/data/{write}/{name}")
        for name in manifests:
            if name not in kept:
                delete_shared(self.spark, f"{base}/manifest/{name}")


__all__ = ["IndexCatalog", "IndexChanged", "IndexNotFound", "normalize_name"]
