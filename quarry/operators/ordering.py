"""Global row numbers and rank selection without a task that holds a prefix of the order.

* ``row_numbers`` deals rows into sorted ranges, counts the ranges, and numbers every row as
  the rows of the ranges before it plus its place in its own.  The ranges are written to the
  shared folder first, so both passes see the same ranges.
* ``key_at_rank`` finds the sort key at a rank by histograms: a bounded sample cuts the keys
  into ranges, one aggregation counts them, and only the range that holds the rank is cut
  again, until it is small.

Keys are compared as structs of the sort columns: NULL first, ties by the next column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from quarry.session import scratch_path

RANGES, SAMPLE, SMALL = 64, 4_096, 50_000


def row_numbers(df: DataFrame, by: list[str], name: str, start: int = 0) -> DataFrame:
    """``df`` with a gapless global number ``name`` (from ``start``) in the order of ``by``.
    Rows that agree in all of ``by`` are numbered in an arbitrary, stored order."""
    spark = df.sparkSession
    path = scratch_path(spark, "row-numbers")
    part, place = "__part", "__place"
    ranged = df.repartitionByRange(*by).sortWithinPartitions(*by)
    # the low 33 bits of this id count the rows of a partition
    ranged.withColumns({part: F.spark_partition_id(), place: F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}).write.parquet(path)
    stored = spark.read.parquet(path)
    counts = stored.groupBy(part).agg(F.count("*").alias("n"))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    starts = counts.select(part, (F.coalesce(F.sum("n").over(before), F.lit(0)) + F.lit(start)).alias("__start"))
    return (stored.join(F.broadcast(starts), part).withColumn(name, F.col("__start") + F.col(place))
            .drop(part, place, "__start"))


def _literal(df: DataFrame, by: list[str], row: Row) -> Column:
    types = dict(zip(df.columns, (f.dataType for f in df.schema.fields)))
    return F.struct(*[F.lit(v).cast(types[c]).alias(c) for c, v in zip(by, row)])


def after_key(df: DataFrame, by: list[str], row: Row) -> DataFrame:
    """Rows after a key; the first column's part of the test reaches the scan."""
    df = df.where(F.struct(*by) > _literal(df, by, row))
    return df if row[0] is None else df.where(F.col(by[0]) >= F.lit(row[0]))


def upto_key(df: DataFrame, by: list[str], row: Row) -> DataFrame:
    df = df.where(F.struct(*by) <= _literal(df, by, row))
    return df if row[0] is None else df.where(F.col(by[0]).isNull() | (F.col(by[0]) <= F.lit(row[0])))


def _cuts(keys: DataFrame, by: list[str]) -> list[Row]:
    """At most ``RANGES - 1`` distinct keys that cut a bounded sample evenly."""
    sample = keys.orderBy(F.xxhash64(*by), *by).limit(SAMPLE)
    held = sample.orderBy(*by).collect()  # at most SAMPLE narrow rows
    step = max(1, len(held) // RANGES)
    return list(dict.fromkeys(held[step::step]))[:RANGES - 1]


def key_at_rank(df: DataFrame, by: list[str], rank: int) -> Row | None:
    """The key (a row of ``by``) of the row at ``rank`` (from 0) in ascending order; None
    beyond the last row.  ``by`` should be unique."""
    keys = df.select(*by)
    if rank < 0:
        raise ValueError("rank must be >= 0")
    while True:
        cuts = _cuts(keys, by)
        if not cuts:  # one key at most
            break
        known = F.array(*[_literal(keys, by, c) for c in cuts])
        of = F.size(F.filter(known, lambda c: c < F.struct(*by)))
        counts = dict(keys.groupBy(of.alias("of")).count().collect())  # at most RANGES rows
        total, at = 0, None
        for k in range(len(cuts) + 1):
            if total + counts.get(k, 0) > rank:
                at = k
                break
            total += counts.get(k, 0)
        if at is None:
            return None
        keys = keys if at == 0 else after_key(keys, by, cuts[at - 1])
        keys = keys if at == len(cuts) else upto_key(keys, by, cuts[at])
        rank -= total
        if counts[at] <= SMALL or counts[at] == sum(counts.values()):
            break
    # fewer than SMALL rows, unless equal keys alone fill the range: then any of them will do
    found = keys.orderBy(*by).offset(rank).limit(1).collect()
    return found[0] if found else None
