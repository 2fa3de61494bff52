"""File-name -> MIME type, and the set of types the loaders accept."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extension -> MIME type table of the document loader (51 entries),
# in the loader's natural order. Unknown extensions map to NULL.
EXTENSION_TYPES = {
    ".txt": "text/plain",
    ".md": "text/markdown",
    ".htm": "text/html",
    ".html": "text/html",
    ".xhtml": "application/xhtml+xml",
    ".xml": "application/xml",
    ".jsonld": "application/ld+json",
    ".css": "text/css",
    ".js": "text/javascript",
    ".sh": "application/x-sh",
    ".bmp": "image/bmp",
    ".gif": "image/gif",
    ".jpeg": "image/jpeg",
    ".jpg": "image/jpeg",
    ".png": "image/png",
    ".tiff": "image/tiff",
    ".tif": "image/tiff",
    ".webp": "image/webp",
    ".svg": "image/svg+xml",
    ".url": "text/x-uri",
    ".text_embedding": "float[]",
    ".json": "application/json",
    ".csv": "text/csv",
    ".pdf": "application/pdf",
    ".rtf": "application/rtf",
    ".doc": "application/msword",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".ppt": "application/vnd.ms-powerpoint",
    ".pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    ".xls": "application/vnd.ms-excel",
    ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    ".odt": "application/vnd.oasis.opendocument.text",
    ".ods": "application/vnd.oasis.opendocument.spreadsheet",
    ".odp": "application/vnd.oasis.opendocument.presentation",
    ".epub": "application/epub+zip",
    ".aac": "audio/aac",
    ".mp3": "audio/mpeg",
    ".wav": "audio/wav",
    ".oga": "audio/ogg",
    ".opus": "audio/opus",
    ".weba": "audio/webm",
    ".mp4": "video/mp4",
    ".mpeg": "video/mpeg",
    ".ogv": "video/ogg",
    ".ogx": "application/ogg",
    ".webm": "video/webm",
    ".tar": "application/x-tar",
    ".gz": "application/gzip",
    ".zip": "application/zip",
    ".rar": "application/vnd.rar",
    ".7z": "application/x-7z-compressed",
}

# The MIME types the loaders read (9 entries).
SUPPORTED_TYPES = (
    "application/pdf",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "application/vnd.ms-powerpoint",
    "application/msword",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "text/markdown",
    "application/vnd.ms-excel",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "text/plain",
)

# Loader family per MIME type (routing is decided for every row).
LOADER_BY_TYPE = {
    "application/pdf": "pdf",
    "application/msword": "word",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "word",
    "application/vnd.ms-powerpoint": "general",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation": "general",
    "text/markdown": "markdown",
    "application/vnd.ms-excel": "general",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "general",
    "text/html": "general",
    "text/plain": "text",
}


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def _literal_map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(d.items())])


def path_name(c: str | Column) -> Column:
    """Last segment of a file path; ``?`` and ``#`` are ordinary characters."""
    return F.regexp_extract(_c(c), r"([^/\\]*)$", 1)


def base_name(c: str | Column) -> Column:
    """Last segment of a web address, without query and fragment."""
    return path_name(F.regexp_replace(_c(c), r"[?#].*$", ""))


def _suffix(name: Column) -> Column:
    """Lower-cased last suffix of a name (like ``pathlib.Path.suffix``), '' if none.

    A leading dot alone (``.bashrc``) is not a suffix; a trailing dot gives ''.
    """
    return F.lower(F.regexp_extract(name, r"^.+?(\.[^.]+)$|^.*$", 1))


def file_suffix(c: str | Column) -> Column:
    """Suffix of a web address's name."""
    return _suffix(base_name(c))


def path_suffix(c: str | Column) -> Column:
    """Suffix of a file path's name."""
    return _suffix(path_name(c))


def mime_from_name(c: str | Column) -> Column:
    """MIME type of a web address by its suffix; NULL when the suffix is unknown."""
    return F.element_at(_literal_map(EXTENSION_TYPES), file_suffix(c))


def mime_from_path(c: str | Column) -> Column:
    """MIME type of a file path by its suffix; NULL when the suffix is unknown."""
    return F.element_at(_literal_map(EXTENSION_TYPES), path_suffix(c))


def is_supported(mime: str | Column) -> Column:
    return F.coalesce(_c(mime).isin(*SUPPORTED_TYPES), F.lit(False))


def loader_for(mime: str | Column) -> Column:
    return F.element_at(_literal_map(LOADER_BY_TYPE), _c(mime))


def mime_from_name_strict(c: str | Column) -> Column:
    """As ``mime_from_name`` but an unknown suffix fails the job with
    ``File type not supported: <name>`` (the loader's strict lookup)."""
    m = mime_from_path(c)
    return F.when(m.isNull(), F.raise_error(F.concat(F.lit("File type not supported: "), _c(c)))).otherwise(m)
