"""Benchmark decontamination: item-sized windows of documents against benchmark items.

A document leaks an item if a window of as many words as the item (or the whole
document, where it is shorter) has a weighted shingle similarity of at least
``similarity``: sum of the smaller counts over sum of the larger counts, over
shingles of five words (an item of fewer words is one shingle).

1. Every shingle of every text is probed against the items' shingles.  Windows
   that can reach the similarity start at such a hit (moving a window's start to
   its first hit loses no shared shingle) and hold enough hits; no other window
   needs to be looked at, whole texts included.
2. Each such window gets a SimHash over its shingles.  Items of the same length
   are indexed by ``radius + 1`` blocks of fingerprint bits: two fingerprints
   within the radius agree in at least one block, so the index finds all of them.
3. Candidates within the radius are verified by the exact similarity.

At similarity 0.8 two fingerprints differ in about 10 of 64 bits (standard
deviation 3); the default radius of 23 is more than four deviations above.

Scale: everything is DataFrame operations.  A benchmark of up to ``INLINE_SHINGLES``
shingles is an array literal that each row's shingles are intersected with, so no text is exploded or shuffled; up to
``BROADCAST_SHINGLES`` it is broadcast, and joined by shuffle beyond.  Hits, windows and
verification are keyed by the hash of the text, and windows by the hash of their
content, so a passage or a text that a third of all rows share is handled once.

Defined cases: words are lower-cased runs of letters and digits; NULL or empty
texts and items without words leak nothing; repeated rows are reported alike; an id that
several items share (NULL too) counts its best one; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import let, quoted, stored, whole

SHINGLE, SIMILARITY, RADIUS = 5, 0.8, 23
#: Distinct item shingles up to the first number are tested inside the row; up to the
#: second (16 bytes each) they are broadcast to the exploded shingles.
INLINE_SHINGLES, BROADCAST_SHINGLES = 10_000, 2_000_000


def terms(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(whole(text)), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(text: Column, n: int) -> Column:
    """Hashes of all runs of ``n`` terms, in order, repeats included."""
    def runs(w: Column) -> Column:
        return F.when(F.size(w) >= n, F.transform(
            F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*[w[i + k] for k in range(n)])))

    return let(F.transform(terms(text), lambda w: F.xxhash64(w)), runs)


def simhash(hashes: Column) -> Column:
    """64-bit SimHash of an array of hashes: the bits set in over half of them.  Four
    bits are counted in one long, 16 bits each, which serves arrays below 65,536."""
    lanes, zero = F.lit(0x0001000100010001), F.lit(0).cast("long")
    out = zero
    for k in range(16):
        sums = F.aggregate(hashes, zero, lambda a, h: a + F.shiftrightunsigned(h, k).bitwiseAND(lanes))
        for lane in range(4):
            count = F.shiftrightunsigned(sums, 16 * lane).bitwiseAND(F.lit(0xFFFF).cast("long"))
            bit = F.shiftleft(F.lit(1).cast("long"), 16 * lane + k)
            out = out.bitwiseOR(F.when(2 * count > F.size(hashes), bit).otherwise(zero))
    return out


def _blocks(fp: Column, radius: int) -> Column:
    """One struct (block, value) for each of ``radius + 1`` runs of fingerprint bits."""
    ends = [64 * k // (radius + 1) for k in range(radius + 2)]
    return F.array(*[F.struct(F.lit(k).alias("block"), F.shiftrightunsigned(fp, a).bitwiseAND(
        F.lit((1 << (b - a)) - 1 if b - a < 64 else -1).cast("long")).alias("value")) for k, (a, b) in enumerate(zip(ends, ends[1:]))])


def _counted(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(key, F.explode("shingles").alias("h")).groupBy(key, "h").agg(F.count(F.lit(1)).alias("n"))


def _with_hits(docs: DataFrame, known: DataFrame, n: int, inline: int) -> DataFrame:
    """Distinct texts that hold a known shingle: (text, all, at), the hash of the text, all
    its shingles and the places of those that are known.

    Up to ``inline`` known shingles are an array inside the row's expression; more are
    joined with the exploded shingles, and the texts found are joined back."""
    key = F.xxhash64(whole("text")).alias("text")
    values = [r[0] for r in known.limit(inline + 1).collect()]
    if 0 < len(values) <= inline:
        listed = F.expr("array(" + ", ".join(
            f"{v}L" if v > -(1 << 63) else "(-9223372036854775807L - 1L)" for v in values) + ")")

        def hits(all_: Column) -> Column:
            return let(F.array_intersect(all_, listed), lambda common: F.when(F.size(common) > 0, F.named_struct(
                F.lit("all"), all_, F.lit("at"), F.filter(F.sequence(F.lit(0), F.size(all_) - 1),
                                                          lambda i: F.array_contains(common, all_[i])))))

        # one expression, so that nothing of it is evaluated again for each shingle
        found = docs.select(key, let(shingles(F.col("text"), n), hits).alias("found")).where("found IS NOT NULL")
        found = found.select("text", "found.all", "found.at")
    else:
        rows = docs.select(key, shingles(F.col("text"), n).alias("all"))
        few = known.count() <= BROADCAST_SHINGLES
        spots = rows.select("text", F.posexplode("all").alias("at", "h"))
        hits = spots.join(F.broadcast(known) if few else known, "h").select("text", "at").distinct()
        hits = stored(hits.groupBy("text").agg(F.array_sort(F.collect_list("at")).alias("at")), "leak-hits")
        found = rows.join(hits, "text")
    return found.groupBy("text").agg(F.first("all").alias("all"), F.first("at").alias("at"))


def _leaks(docs: DataFrame, items: DataFrame, n: int, similarity: float, radius: int, inline: int) -> DataFrame:
    """(text, item_id, similarity, start) for items (item_id, shingles) of ``n``-term shingles."""
    items = items.withColumn("m", F.size("shingles"))
    least = similarity / (1 + similarity)  # of the shingles of both sides
    known = stored(items.select(F.explode("shingles").alias("h"), "m").distinct(), "leak-shingles")
    # 1. texts with hits, hits (text, place) by item length, and the windows that start at one
    texts = stored(_with_hits(docs, known.select("h").distinct(), n, inline), "leak-texts")
    spots = texts.select("text", "all", F.explode("at").alias("at")).select(
        "text", "at", F.col("all")[F.col("at")].alias("h"))
    few = known.count() <= BROADCAST_SHINGLES
    hits = spots.join(F.broadcast(known) if few else known, "h")
    hits = hits.select("text", "m", "at").distinct()
    texts = texts.drop("at")
    places = hits.groupBy("text", "m").agg(F.array_sort(F.collect_list("at")).alias("at"))  # at most one text's places
    last = F.greatest(F.size("all") - F.col("m"), F.lit(0))
    width = F.least(F.size("all"), F.col("m"))
    # hits from place i on that lie in the window: those up to the last place before its end
    starts = places.join(texts, "text").withColumns({"last": last, "width": width})
    enough = F.ceil(least * (F.col("m") + F.col("width")) - 1e-9).cast("int")
    dense = F.filter(F.sequence(F.lit(0), F.size("at") - 1), lambda i: (
        (i + F.col("need") <= F.size("at"))
        & (F.element_at("at", F.least(i + F.col("need"), F.size("at"))) < F.col("at")[i] + F.col("width"))
    ) | (F.col("at")[i] > F.col("last")))
    first = F.array_distinct(F.transform(F.col("dense"), lambda i: F.least(F.col("at")[i], F.col("last"))))
    windows = (starts.withColumn("need", enough).where(F.size("at") >= F.col("need")).withColumn("dense", dense)
               .select("text", "m", F.explode(F.transform(first, lambda s: F.struct(
                   s.alias("start"), F.slice("all", s + 1, F.col("width")).alias("shingles")))).alias("w"))
               .select("text", "m", "w.start", "w.shingles")
               .withColumn("window", F.xxhash64("m", "shingles")))
    windows = stored(windows, "leak-windows")
    # 2. fingerprints of distinct windows against the items of their length
    contents = stored(windows.groupBy("window").agg(F.first("m").alias("m"), F.first("shingles").alias("shingles"))
                      .withColumn("fp", simhash(F.col("shingles"))), "leak-contents")
    prints = items.select("item_id", "m", simhash(F.col("shingles")).alias("item_fp"))
    index = prints.select("item_id", "m", "item_fp", F.explode(_blocks(F.col("item_fp"), radius)).alias("b"))
    probes = contents.select("window", "m", "fp", F.explode(_blocks(F.col("fp"), radius)).alias("b"))
    near = (probes.join(index, ["m", "b"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius)
            .select("window", "item_id").distinct())
    # 3. the exact similarity
    shared = (near.join(_counted(contents, "window"), "window")
              .join(_counted(items, "item_id").withColumnRenamed("n", "n2"), ["item_id", "h"])
              .groupBy("window", "item_id").agg(F.sum(F.least("n", "n2")).alias("both")))
    sized = (shared.join(contents.select("window", F.size("shingles").alias("w")), "window")
             .join(items.select("item_id", "m"), "item_id")
             .withColumn("similarity", F.col("both") / (F.col("w") + F.col("m") - F.col("both")))
             .where(F.col("similarity") >= similarity).select("window", "item_id", "similarity"))
    return (windows.select("window", "text", "start").join(sized, "window").groupBy("text", "item_id")
            .agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"))).alias("best"))
            .select("text", "item_id", "best.similarity", (-F.col("best.back")).alias("start")))


def leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
          item_col: str = "item_id", item_text_col: str = "text", similarity: float = SIMILARITY,
          radius: int = RADIUS, inline: int = INLINE_SHINGLES) -> DataFrame:
    """(doc_id, item_id, similarity, start): the best window of every leaked item, its
    first term's place counted from 0."""
    rows = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).alias("text"))
    found = _text_leaks(rows, benchmark, item_col, item_text_col, similarity, radius, inline)
    return (rows.select("doc_id", F.xxhash64(whole("text")).alias("text")).join(found, "text")
            .select("doc_id", "item_id", F.round("similarity", 6).alias("similarity"), "start"))


def _text_leaks(rows: DataFrame, benchmark: DataFrame, item_col: str, item_text_col: str, similarity: float,
                radius: int, inline: int = INLINE_SHINGLES) -> DataFrame:
    # an item is an id with a text: ids may be NULL or repeat with other texts
    items = stored(benchmark.select(quoted(item_col).alias("id"), quoted(item_text_col).alias("body"))
                   .withColumn("n", F.least(F.size(terms(F.col("body"))), F.lit(SHINGLE))).where("n > 0").distinct()
                   .withColumn("item_id", F.xxhash64("id", "body")), "leak-items")
    found = None
    for n in range(1, SHINGLE + 1):
        here = items.where(F.col("n") == n)
        if here.isEmpty():
            continue
        here = stored(here.select("item_id", shingles(F.col("body"), n).alias("shingles")), "leak-items")
        part = _leaks(rows, here, n, similarity, radius, inline)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = rows.sparkSession.createDataFrame([], "text long, item_id long, similarity double, start int")
    named = found.join(items.select("item_id", "id"), "item_id").groupBy("text", "id").agg(
        F.max(F.struct("similarity", (-F.col("start")).alias("back"))).alias("best"))
    return stored(named.select("text", F.col("id").alias("item_id"), "best.similarity",
                               (-F.col("best.back")).alias("start")), "leak-found")


def decontaminated(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id",
                   item_text_col: str = "text", similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` that leak no item."""
    rows = docs.select(quoted(text_col).alias("text"))
    found = _text_leaks(rows, benchmark, item_col, item_text_col, similarity, radius).select(
        F.col("text").alias("__q_leak")).distinct()
    return docs.join(found, F.xxhash64(whole(quoted(text_col))) == F.col("__q_leak"), "left_anti")
