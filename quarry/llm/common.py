"""Helpers shared by the corpus operators (JVM-side column builders, scratch tables)."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import scratch_path

#: ASCII white space that separates words, as a Java regular expression.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` into the shared folder of ``spark.checkpoint.dir`` and read it
    back: lineage is cut, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("error").options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def whole(text: str | Column) -> Column:
    """The text, with NULL as the empty text."""
    col = F.col(text) if isinstance(text, str) else text
    return F.coalesce(col.cast("string"), F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; no words for an empty or NULL one."""
    return F.filter(F.split(whole(text), SPACE), lambda w: w != F.lit(""))


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only.  A text of one byte per character has no other letters
    that ``lower`` could change, so the faster built-in serves there."""
    return (F.when(F.length(text) == F.octet_length(text), F.lower(text))
            .otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase)))


def id_crc32(id_col: str | Column) -> Column:
    """crc32 of an id written as text (NULL as the empty text)."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary"))


def quoted(name: str) -> Column:
    """A column by its exact name (dots and backticks included)."""
    return F.col("`" + name.replace("`", "``") + "`")
