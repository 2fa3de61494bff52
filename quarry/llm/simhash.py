"""SimHash near-duplicate detection with bit-sliced comparison.

Fingerprint: words of the A-Z lower-cased text, shingles of ``shingle`` words
(repeats included), XXH64 of each; a bit is set if it is set in over half of them.
Two fingerprints link at ``radius`` or fewer differing bits; documents in one
connected component are near-duplicates.

1. Equal fingerprints collapse by an aggregation, so groups of exact copies cost
   one row from here on.
2. Multi-index: with ``radius + 1`` blocks of bits, linked fingerprints agree in at
   least one block.  Buckets are (block, value).  A bucket above ``BUCKET`` rows is
   indexed again by blocks of its remaining bits (exact by the same argument), and
   what is still above is cut into pieces that are compared pair by pair in separate
   groups, so no task holds an unbounded bucket.
3. Within a batch of buckets the fingerprints are stored as 64 bit planes, 64
   fingerprints to a machine word.  Distances of all rows to the row ``d`` places
   on are updated plane by plane in carry-save counters (ones, twos, and a flag for
   four and more); after each few planes the words whose 64 lanes all exceed the
   radius are abandoned.
4. A batch emits a spanning forest of its links (never all pairs), and large-star /
   small-star rounds join the forests: each is one aggregation and one join on
   skew-splittable keys, checkpointed in the shared folder.

Defined cases: NULL and empty texts have fingerprint zero and link like any other;
fewer words than a shingle give one shingle of all words; repeated rows get the same
result; rows with a NULL id take part, and a component's id is its smallest non-NULL
id (NULL if it has none); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import let, lower_ascii, quoted, stored, whole, words

SHINGLE, RADIUS = 3, 3
#: Fingerprints of one bucket that are compared in one group.
BUCKET = 4_096


def shingle_hashes(text: Column, n: int) -> Column:
    """XXH64 (seed 42) of every run of ``n`` words, joined by single spaces."""
    def runs(w: Column) -> Column:
        return F.when(F.size(w) >= n, F.transform(
            F.sequence(F.lit(0), F.size(w) - n),
            lambda i: F.xxhash64(F.concat_ws(" ", *[w[i + k] for k in range(n)])))
        ).when(F.size(w) > 0, F.array(F.xxhash64(F.concat_ws(" ", w)))).otherwise(F.array().cast("array<long>"))

    return let(words(lower_ascii(whole(text))), runs)


def majority_bits(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Fingerprint per list: ``hashes[offsets[i]:offsets[i + 1]]`` (uint64); bit set if it
    is set in over half the hashes, zero for an empty list.

    Eight bit counters of eight bits each share a word, so a word sums 255 hashes
    before it is unpacked."""
    out = np.zeros(len(offsets) - 1, np.uint64)
    lengths = np.diff(offsets)
    full = np.flatnonzero(lengths)
    if not len(full):
        return out
    pieces = -(-lengths[full] // 255)
    first = np.concatenate(([0], np.cumsum(pieces)[:-1]))
    inner = np.arange(pieces.sum()) - np.repeat(first, pieces)
    starts = np.repeat(offsets[full], pieces) + 255 * inner
    lanes = np.uint64(0x0101010101010101)
    hashes = hashes[offsets[0]:offsets[-1]]
    starts = starts - offsets[0]
    for k in range(8):
        packed = np.add.reduceat((hashes >> np.uint64(k)) & lanes, starts)
        counts = np.add.reduceat(packed.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        bits = counts * 2 > lengths[full][:, None]
        for byte in range(8):
            out[full] |= bits[:, byte].astype(np.uint64) << np.uint64(8 * byte + k)
    return out


def _majority(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(batch.num_columns - 1)
        offsets = np.asarray(lists.offsets).astype(np.int64)
        bits = majority_bits(np.asarray(lists.values).view(np.uint64), offsets)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(bits.view(np.int64))],
                                         [*batch.schema.names[:-1], "fp"])


def _narrow(docs: DataFrame, shingle: int, text_col: str, **columns: Column) -> DataFrame:
    """The given columns with ``fp``, the SimHash of the text as a signed long."""
    with_hashes = docs.select(*[c.alias(k) for k, c in columns.items()],
                              shingle_hashes(quoted(text_col), shingle).alias("fp"))
    schema = T.StructType([*with_hashes.schema.fields[:-1], T.StructField("fp", T.LongType())])
    return with_hashes.mapInArrow(_majority, schema)


# -- bit-sliced links ---------------------------------------------------------------

def _planes(values: np.ndarray) -> np.ndarray:
    """64 x words: bit ``i`` of word ``w`` of plane ``b`` is bit ``b`` of row ``64 w + i``."""
    rows = -(-len(values) // 64) * 64 + 64
    padded = np.zeros(rows, np.uint64)
    padded[:len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(rows, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def _within(planes: np.ndarray, d: int, n: int, radius: int) -> np.ndarray:
    """Rows ``i < n`` whose distance to row ``i + d`` is at most ``radius`` (0 to 3)."""
    shift, bits = divmod(d, 64)
    count = -(-n // 64)
    alive = np.arange(count)
    ones = np.zeros(count, np.uint64)
    twos, over = ones.copy(), ones.copy()
    full, up, down = ~np.uint64(0), np.uint64(bits), np.uint64(64 - bits)
    last = planes.shape[1] - 1
    for block in range(0, 64, 8):
        lo, hi = np.minimum(alive + shift, last), np.minimum(alive + shift + 1, last)
        for plane in planes[block:block + 8]:
            other = plane[lo] if not bits else (plane[lo] >> up) | (plane[hi] << down)
            differ = plane[alive] ^ other
            carry = ones & differ
            ones ^= differ
            over |= twos & carry
            twos ^= carry
        beyond = over | (twos & ones if radius == 2 else twos if radius == 1 else twos | ones if radius == 0 else over)
        keep = beyond != full
        if not keep.all():
            alive, ones, twos, over, beyond = alive[keep], ones[keep], twos[keep], over[keep], beyond[keep]
        if not len(alive):
            return alive
    lanes = np.unpackbits((~beyond).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    word, lane = np.nonzero(lanes)
    rows = alive[word] * 64 + lane
    return rows[rows < n]


def _join(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union of the pairs; ``parent`` points at each row's smallest connected row."""
    while True:
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        if not apart.any():
            return parent
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while not np.array_equal(parent, up := parent[parent]):
            parent = up


def linked_rows(buckets: np.ndarray, values: np.ndarray, radius: int) -> np.ndarray:
    """For rows sorted by bucket: the smallest row each row is connected to by links
    within its bucket."""
    n = len(values)
    parent = np.arange(n)
    if n < 2:
        return parent
    edges = np.flatnonzero(np.r_[True, buckets[1:] != buckets[:-1]])
    sizes = np.diff(np.r_[edges, n])
    order = np.argsort(-sizes, kind="stable")  # large buckets first: the rows of a step are a prefix
    sizes, edges = sizes[order], edges[order]
    first = np.r_[0, np.cumsum(sizes)[:-1]]
    at = np.repeat(edges - first, sizes) + np.arange(n)  # place in the given order
    planes = _planes(values[at])
    left = np.repeat(first + sizes, sizes) - np.arange(n)  # rows of the bucket from here on
    for d in range(1, int(sizes[0])):
        k = int(np.searchsorted(-sizes, -d, side="left")) - 1  # the last bucket of more than d rows
        rows = _within(planes, d, min(int(first[k] + sizes[k]), n - d), radius)
        rows = rows[left[rows] > d]
        if len(rows):
            parent = _join(parent, at[rows], at[rows + d])
    return parent


def _forest(radius: int):
    """Batches of (bucket, value), sorted by bucket -> links (a, b) of a spanning forest."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(bucket: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
            parent = linked_rows(bucket, value.view(np.uint64), radius)
            child = np.flatnonzero(parent != np.arange(len(parent)))
            return pa.RecordBatch.from_arrays([pa.array(value[child]), pa.array(value[parent[child]])], ["a", "b"])

        bucket, value = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            bucket = np.concatenate([bucket, np.asarray(batch.column(0))])
            value = np.concatenate([value, np.asarray(batch.column(1))])
            if len(bucket):  # the last bucket may go on in the next batch
                cut = int(np.where(bucket != bucket[-1])[0][-1]) + 1 if bucket[0] != bucket[-1] else 0
                if cut:
                    yield links(bucket[:cut], value[:cut])
                    bucket, value = bucket[cut:], value[cut:]
        if len(bucket):
            yield links(bucket, value)
    return run


def _blocks(width: int, pieces: int) -> list[tuple[int, int]]:
    """(first bit, bits) of ``pieces`` runs that make up ``width`` bits."""
    ends = [width * k // pieces for k in range(pieces + 1)]
    return [(a, b - a) for a, b in zip(ends, ends[1:])]


def _bits(value: Column, first: int, n: int) -> Column:
    return F.shiftrightunsigned(value, first).bitwiseAND(F.lit((1 << n) - 1).cast("long")) if n < 64 else value


def _indexed(rows: DataFrame, blocks: list[tuple[int, int]], value: Column) -> DataFrame:
    """One row per block: ``bucket`` is a hash of the bucket so far, the block and its value."""
    return rows.withColumn("__q_block", F.explode(F.array(*[
        F.struct(F.lit(k).alias("k"), _bits(value, *b).alias("v"),
                 # the bits that are left, the block taken out
                 F.shiftleft(F.shiftrightunsigned(value, sum(b)), b[0]).bitwiseOR(_bits(value, 0, b[0])).alias("rest"))
        if sum(b) < 64 else F.struct(F.lit(k).alias("k"), _bits(value, *b).alias("v"), _bits(value, 0, b[0]).alias("rest"))
        for k, b in enumerate(blocks)]))).withColumns({
            "bucket": F.xxhash64("bucket", "__q_block.k", "__q_block.v"), "rest": F.col("__q_block.rest")}
    ).drop("__q_block")


def _parted(rows: DataFrame, most: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of buckets of up to ``most`` rows, and the rest with ``rows``, their bucket's size."""
    large = stored(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > most),
                   "simhash-large")
    if large.isEmpty():
        return rows, None
    return rows.join(large, "bucket", "left_anti"), rows.join(large, "bucket")


def fingerprint_links(values: DataFrame, radius: int = RADIUS, bucket_rows: int = BUCKET) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of ``values`` (distinct longs
    ``fp``) at ``radius`` or fewer differing bits."""
    if not 0 <= radius <= 3:
        raise ValueError("the bit counters serve radii 0 to 3")
    pieces = radius + 1
    rows = values.select("fp", F.lit(0).cast("long").alias("bucket"), F.col("fp").alias("rest"))
    level = _indexed(rows, _blocks(64, pieces), F.col("rest"))
    small, large = _parted(level, bucket_rows)
    parts = [small]
    if large is not None:
        # the blocks differ in width by a bit at most; the narrowest remainder is indexed again
        width = 64 - max(n for _, n in _blocks(64, pieces))
        level = _indexed(large.drop("rows"), _blocks(width, pieces), F.col("rest"))
        small, large = _parted(level, bucket_rows)
        parts.append(small)
        if large is not None:
            n = F.ceil(2 * F.col("rows") / bucket_rows).cast("int")
            own = F.pmod(F.xxhash64("fp"), n).cast("int")
            cells = F.transform(F.filter(F.sequence(F.lit(0), F.col("__q_n") - 1), lambda q: q != F.col("__q_own")),
                                lambda q: F.xxhash64("bucket", F.least(q, "__q_own"), F.greatest(q, "__q_own")))
            parts.append(large.withColumns({"__q_n": n, "__q_own": own}).withColumn("bucket", F.explode(cells)))
    rows = None
    for part in parts:
        part = part.select("bucket", "fp")
        rows = part if rows is None else rows.unionByName(part)
    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_forest(radius), "a long, b long")


# -- connected components ------------------------------------------------------------

def _star(of: DataFrame, large: bool) -> DataFrame:
    """One star round over ``of`` (u, v): neighbours move to the smallest of them."""
    least = of.groupBy("u").agg(F.min("v").alias("m"))
    if large:
        least = least.withColumn("m", F.least("u", "m"))
        moved = of.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        joined = of.join(least, "u")
        moved = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node connected to each node of ``links`` (a, b)."""
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                   .distinct(), "simhash-links")
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        edges = stored(_star(_star(both, True), False), "simhash-stars")
        now = tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")),
                              F.bit_xor(F.xxhash64("v", "u"))).first())
        if now == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = now


# -- documents -----------------------------------------------------------------------

def _assigned(base: DataFrame, radius: int) -> DataFrame:
    """``base`` (doc_id, fp, ...) with ``root`` and ``component_id``."""
    kinds = stored(base.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-kinds")
    roots = components(fingerprint_links(kinds.select("fp"), radius))
    placed = kinds.join(roots, kinds["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    table = stored(placed.select("fp", "root").join(ids, "root"), "simhash-components")
    return base.join(table, "fp")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row per document: (doc_id, fingerprint as 16 hex digits, component_id)."""
    base = stored(_narrow(docs, shingle, text_col, doc_id=quoted(id_col)), "simhash-fingerprints")
    return _assigned(base, radius).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                                          "component_id")


def deduplicated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                 shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component one row stays,
    that of the smallest id (NULL last; of rows that share it, one text)."""
    key = {"__q_k1": F.xxhash64(quoted(id_col), quoted(text_col)),
           "__q_k2": F.xxhash64(F.lit(1), quoted(text_col), quoted(id_col))}
    base = stored(_narrow(docs, shingle, text_col, doc_id=quoted(id_col), **key), "simhash-fingerprints")
    kept = _assigned(base, radius).groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__q_k1", "__q_k2")).alias("s")).select(
        F.col("s.__q_k1").alias("__q_k1"), F.col("s.__q_k2").alias("__q_k2"))
    rows = docs.withColumns(key).join(kept, ["__q_k1", "__q_k2"])
    return rows.dropDuplicates(["__q_k1", "__q_k2"]).select(*[quoted(c) for c in docs.columns])
