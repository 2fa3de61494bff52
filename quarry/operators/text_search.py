"""Full-text matching and cover-density ranking.

``to_tsvector``-like normalisation: lower-case, split on anything that is not a
letter or digit, drop stop words; positions count every word (stop words
included). A query matches a record when every distinct query lexeme occurs in
it (``plainto_tsquery`` AND semantics); a query made only of stop words matches
nothing.

Plan (per query batch), one scan and one tokenise pass of the records, no exchange
of them and no job while the plan is built:

1. each record row holds its token array;
2. each query has one key lexeme - its longest, ties by code point; a match must
   hold it, so the keys found in a row (a hash-set test inside the row, or a join on
   exploded tokens for a large batch) give the candidate pairs, a superset of the
   matches;
3. the candidates are verified and scored inside the row: the query's lexemes
   against the record's tokens, then a fold over the hits (bounded by the record's
   length) gives the cover-density score;
4. top-k per query by ``row_number``, which Spark plans with a partial limit.

A saved ``LexemeIndex`` holds the token arrays by id and ``(lexeme, id)`` pairs, range
partitioned by both, so step 2 reads the key lexemes' postings only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.stopwords import FRENCH
from quarry.functions.text import word_tokens

MAX_QUERY_LEXEMES = 2_000             # key lexemes of a batch tested inside the row
MAX_IN_LIST = 256                     # literal IN lists above this size become a broadcast semi-join
MAX_BROADCAST_QUERIES = 200_000       # query rows broadcast to the candidates
COVER_WEIGHT = 0.1  # weight of an unlabelled (class D) lexeme


def kept_tokens(text: str | Column, stemmer: Callable[[Column], Column] | None = None,
                stop_words=FRENCH) -> Column:
    """All words in order; stop words and empty strings are ``''`` so positions stay."""
    stem = stemmer or (lambda w: w)
    return F.transform(word_tokens(text), lambda w: F.when(
        (w != "") & ~w.isin(list(stop_words)), stem(w)).otherwise(F.lit("")))


def lexemes(df: DataFrame, key: str, text: str,
            stemmer: Callable[[Column], Column] | None = None,
            stop_words=FRENCH) -> DataFrame:
    """``(key, lexeme, pos)`` with 1-based word positions."""
    return (df.select(F.col(key), F.posexplode(kept_tokens(text, stemmer, stop_words)).alias("pos0", "lexeme"))
            .where(F.col("lexeme") != "").select(key, "lexeme", (F.col("pos0") + 1).alias("pos")))


class LexemeIndex:
    """Token arrays of a record table and, once saved, its postings.

    * ``tokens`` ``(id, tokens)``  - one row per record;
    * ``terms``  ``(lexeme, id)``  - one row per record and lexeme.

    ``build`` is lazy; ``save`` writes both once - ``terms`` range-partitioned and
    sorted by ``(lexeme, id)``, so a lexeme that every record holds is spread over many
    files and the lookup of a few lexemes skips most files by their statistics - and
    ``load`` reads them back for any number of query batches.
    """

    def __init__(self, tokens: DataFrame, terms: DataFrame, saved: bool = False):
        self.tokens, self.terms, self.saved = tokens, terms, saved

    @classmethod
    def build(cls, records: DataFrame, stemmer=None) -> "LexemeIndex":
        tokens = records.select("id", kept_tokens("content", stemmer).alias("tokens"))
        terms = tokens.select(F.explode(F.array_distinct("tokens")).alias("lexeme"), "id").where("lexeme <> ''")
        return cls(tokens, terms)

    def save(self, path: str, n_files: int | None = None) -> "LexemeIndex":
        path = path.rstrip("/")
        spark = self.tokens.sparkSession
        n = n_files or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.tokens.repartition(n, "id").sortWithinPartitions("id").write.mode("errorifexists").parquet(f"{path}/tokens")
        (self.terms.repartitionByRange(n, "lexeme", "id").sortWithinPartitions("lexeme", "id")
         .write.mode("errorifexists").parquet(f"{path}/terms"))
        return LexemeIndex.load(spark, path)

    @classmethod
    def load(cls, spark, path: str) -> "LexemeIndex":
        path = path.rstrip("/")
        return cls(*[spark.read.parquet(f"{path}/{t}") for t in ("tokens", "terms")], saved=True)


def query_lexemes(queries: DataFrame, stemmer=None) -> DataFrame:
    """``(query_id, terms, key)``: the distinct lexemes of every query in order, and
    the longest of them; queries without a lexeme are left out."""
    terms = F.array_sort(F.array_distinct(F.filter(kept_tokens("query_text", stemmer), lambda w: w != "")))
    longest = F.array_max(F.transform("terms", lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    return (queries.select("query_id", terms.alias("terms")).where(F.size("terms") > 0)
            .withColumn("key", longest))


def cover_density(hits: Column, n_terms: Column) -> Column:
    """Sum over minimal covers of ``0.1 / (1 + noise)``.

    ``hits`` is ``array<struct<pos:int, term:int>>`` sorted by position; a cover
    ending at hit i starts at the smallest "last index" over all terms, it is
    minimal exactly when that start moved since the previous complete step,
    and ``noise = (pos_end - pos_start) - (i - start)``.
    """
    init = F.struct(
        F.array_repeat(F.lit(-1), n_terms.cast("int")).alias("last"),
        F.lit(-1).alias("prev"),
        F.lit(0.0).alias("score"),
        F.lit(0).alias("i"),
    )

    def bound(value: Column, body: Callable[[Column], Column]) -> Column:
        """``body(value)`` with ``value`` evaluated once a step."""
        return F.element_at(F.transform(F.array(value), body), 1)

    def step(acc, h):
        i = acc["i"]

        def covered(last: Column, s: Column) -> Column:
            new_cover = (s >= 0) & (s > acc["prev"])
            noise = (h["pos"] - F.element_at(hits, s + 1)["pos"]) - (i - s)
            noise = F.when(noise < 0, (i - s) / 2.0).otherwise(noise)
            gain = F.when(new_cover, F.lit(COVER_WEIGHT) / (F.lit(1.0) + noise)).otherwise(F.lit(0.0))
            return F.struct(last.alias("last"), F.when(s >= 0, s).otherwise(acc["prev"]).alias("prev"),
                            (acc["score"] + gain).alias("score"), (i + 1).alias("i"))

        last = F.transform(acc["last"], lambda x, j: F.when(j == h["term"], i).otherwise(x))
        return bound(last, lambda held: bound(F.array_min(held), lambda s: covered(held, s)))

    return F.aggregate(hits, init, step, lambda acc: acc["score"])


def keep_lexemes(df: DataFrame, lexemes_: list[str]) -> DataFrame:
    """Rows whose ``lexeme`` is in the given (driver-side, bounded) set.

    A short set is a literal ``IN`` (reaches Parquet min/max pruning of a
    lexeme-sorted index); a long one is a broadcast left-semi join."""
    if not lexemes_:
        return df.limit(0)
    if len(lexemes_) <= MAX_IN_LIST:
        return df.where(F.col("lexeme").isin(lexemes_))
    keys = df.sparkSession.createDataFrame([(w,) for w in lexemes_], "lexeme string")
    return df.join(F.broadcast(keys), "lexeme", "left_semi")


def _pairs(index: LexemeIndex, queries: DataFrame, stemmer, max_query_lexemes: int) -> DataFrame:
    """``(query_id, id, terms, tokens)`` of the matches: candidates by key lexeme whose
    tokens hold all lexemes of the query."""
    ql = query_lexemes(queries, stemmer)
    # one bounded read of the query side: its distinct keys
    keys = [r[0] for r in ql.select("key").distinct().limit(max_query_lexemes + 1).collect()]
    small = len(keys) <= max_query_lexemes
    if small and not index.saved:
        found = F.filter(F.array_distinct("tokens"), lambda w: w.isin(keys)) if keys else F.array().cast("array<string>")
        rows = index.tokens.select("id", "tokens", F.explode(found).alias("key"))
        pairs = rows.join(F.broadcast(ql) if ql.count() <= MAX_BROADCAST_QUERIES else ql, "key")
    else:
        terms = keep_lexemes(index.terms, keys) if small else index.terms
        pairs = (terms.withColumnRenamed("lexeme", "key").join(ql, "key").join(index.tokens, "id"))
    return pairs.where(F.size(F.array_except("terms", "tokens")) == 0).select("query_id", "id", "terms", "tokens")


def text_matches(index: LexemeIndex, queries: DataFrame, stemmer=None, max_query_lexemes: int = MAX_QUERY_LEXEMES) -> DataFrame:
    """``(query_id, id)`` pairs where the record holds every query lexeme."""
    if hasattr(index, "matches"):  # a saved PostingsIndex
        return index.matches(queries)
    return _pairs(index, queries, stemmer, max_query_lexemes).select("query_id", "id")


def text_search(records: DataFrame, queries: DataFrame, k: int | None = None, *,
                length_norm: bool = False, stemmer=None,
                index: LexemeIndex | None = None, only: DataFrame | None = None,
                max_query_lexemes: int = MAX_QUERY_LEXEMES) -> DataFrame:
    """``(query_id, id, text_score, text_rank)``; ``text_rank`` orders by score
    desc then id. ``k`` keeps the first k per query; without it (``None``/``<=0``) all
    matches are returned and ``text_rank`` is NULL (numbering every match of a query
    would need one task).

    ``length_norm`` divides the score by ``ln(1 + number of lexeme positions)``.
    Pass a saved ``LexemeIndex`` or ``PostingsIndex`` (``quarry.operators.postings``) to
    serve many query batches from one index; ``only (id)`` then limits the matches to some
    records.
    """
    if hasattr(index, "search"):
        return index.search(queries, k, length_norm=length_norm, only=only)
    index = index if index is not None else LexemeIndex.build(records, stemmer)
    pairs = _pairs(index, queries, stemmer, max_query_lexemes)
    if only is not None and index.saved:
        pairs = pairs.join(only.select("id"), "id", "left_semi")
    placed = F.filter(F.transform("tokens", lambda w, i: F.struct(
        (i + 1).alias("pos"), (F.array_position("terms", w) - 1).cast("int").alias("term"))), lambda h: h["term"] >= 0)
    hits = pairs.select("query_id", "id", F.size("terms").alias("n_terms"), placed.alias("hits"),
                        F.size(F.filter("tokens", lambda w: w != "")).alias("n_pos"))
    score = cover_density(F.col("hits"), F.col("n_terms"))
    if length_norm:
        score = score / F.log(F.col("n_pos") + F.lit(1.0))
    scored = hits.select("query_id", "id", score.alias("text_score"))
    if k is None or k <= 0:
        return scored.withColumn("text_rank", F.lit(None).cast("int"))
    w = Window.partitionBy("query_id").orderBy(F.col("text_score").desc(), F.col("id").asc())
    return scored.withColumn("text_rank", F.row_number().over(w)).where(F.col("text_rank") <= k)
