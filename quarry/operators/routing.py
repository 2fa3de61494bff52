"""Source files: listing, MIME routing and the already-imported check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.mime import (
    base_name, file_suffix, is_supported, loader_for, mime_from_name, mime_from_path, path_name, path_suffix,
)
from quarry.operators.ordering import row_numbers


def route_files(files: DataFrame, path: str = "path", web: bool = False) -> DataFrame:
    """Add ``name, suffix, mime_type, supported, loader`` to every row; each row
    is routed on its own type (unknown suffix -> NULL type, not supported).
    ``web``: the paths are web addresses, whose query and fragment are no part of the name."""
    c = F.col(path)
    name, suffix, mime = ((base_name(c), file_suffix(c), mime_from_name(c)) if web
                          else (path_name(c), path_suffix(c), mime_from_path(c)))
    return files.select(
        "*", name.alias("name"), suffix.alias("suffix"),
        mime.alias("mime_type"), is_supported(mime).alias("supported"),
        F.when(is_supported(mime), loader_for(mime)).alias("loader"))


def supported_files(files: DataFrame, path: str = "path") -> DataFrame:
    return route_files(files, path).where("supported")


def skip_imported(files: DataFrame, ready: DataFrame, key: str = "document_id") -> DataFrame:
    """Files whose document is not imported yet (anti-join)."""
    return files.join(ready.select(key), key, "left_anti")


def document_ids(files: DataFrame, path: str = "path") -> DataFrame:
    """Stable ``doc<hash>`` ids from the path: reruns over other files give the same id."""
    return files.withColumn("document_id",
                            F.concat(F.lit("doc"), F.substring(F.sha2(F.col(path), 256), 1, 16)))


def document_ordinals(files: DataFrame, path: str = "path") -> DataFrame:
    """``doc<i>`` ids by the place of a file in the listing ordered by path (from 0), numbered
    over sorted ranges: no task holds the listing.  A path that repeats is numbered each time."""
    numbered = row_numbers(files, [path], "ordinal")
    return numbered.withColumn("document_id", F.concat(F.lit("doc"), F.col("ordinal").cast("string")))
