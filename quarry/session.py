"""Session construction and the shared working folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "quarry") -> SparkSession:
    """Return a session with adaptive execution and skew handling switched on.

    On a cluster ``master`` is left to spark-submit; tests pass ``local[*]``.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    builder = (
        builder.config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this setting points at shared storage and is only read here.
    When it is unset, a local session gets a private folder (any other master is an
    error: its executors would not see the driver's disk); the folder is registered, so ``DataFrame.checkpoint()`` and written tables work.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.conf.get("spark.master", "local")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="quarry-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    try:
        sc = spark.sparkContext
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(path)
    except Exception:  # noqa: BLE001 - no SparkContext handle (Spark Connect)
        pass
    return path.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-path of the shared folder for a materialised table."""
    import uuid

    return os.path.join(shared_dir(spark), "quarry", f"{name}-{uuid.uuid4().hex}")


def open_shared(path: str):
    """(Arrow file system, path) of a place in the shared folder, for reads inside tasks."""
    from pyarrow import fs

    if path.startswith("/"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[len("file:"):].lstrip("/")
    for alias in ("s3a://", "s3n://"):
        if path.startswith(alias):
            path = "s3://" + path[len(alias):]
    return fs.FileSystem.from_uri(path)


def _store(spark: SparkSession, path: str):
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place, jvm.org.apache.hadoop.fs.Path


def list_shared(spark: SparkSession, path: str) -> dict[str, int]:
    """Names directly below a shared folder with their times; none for a missing one."""
    store, place, _ = _store(spark, path)
    return {s.getPath().getName(): s.getModificationTime() for s in store.listStatus(place)} if store.exists(place) else {}


def has_folder(spark: SparkSession, pattern: str) -> bool:
    """Whether a path, or a path that a pattern matches, is a folder."""
    store, place, _ = _store(spark, pattern)
    return any(s.isDirectory() for s in store.globStatus(place) or [])


def touch_shared(spark: SparkSession, path: str) -> None:
    """An empty file."""
    store, place, _ = _store(spark, path)
    store.create(place, True).close()


def delete_shared(spark: SparkSession, path: str) -> None:
    """Remove a file or folder of this library in the shared folder; a missing one is fine."""
    store, place, _ = _store(spark, path)
    store.delete(place, True)


def state_shared(spark: SparkSession, path: str) -> tuple[int, int, int]:
    """(bytes, files, time of the last change) of a file or folder."""
    store, place, _ = _store(spark, path)
    summary = store.getContentSummary(place)
    return summary.getLength(), summary.getFileCount(), store.getFileStatus(place).getModificationTime()
