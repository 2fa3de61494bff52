"""Statistical stand-in for question rewriting: the key terms of a question.

Per question, its distinct non-stop-word lexemes ranked by corpus IDF
``ln((1 + N) / (1 + df))`` (rarest first, then alphabetical), top ``k``.
This is a substitute for the model-based rewriting, not a reproduction.

``key_expressions`` gives expressions instead of single words, written as in the question:

* candidates are the 1 to ``MAX_WORDS`` consecutive words between stop words and punctuation;
* an expression of several words stands if the corpus holds it twice or more, or if all its
  words are capitalised (names, which the corpus need not know);
* a candidate that occurs no oftener than the standing expressions around it in the question
  (f + 1 less the mean f + 1 of these: the nested part of the C-value) is part of them and goes;
* what is left is ranked by log2(1 + words) x ln((1 + N) / (1 + df)), then by place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.stopwords import FRENCH
from quarry.operators.text_search import lexemes
from quarry.session import scratch_path


def document_frequencies(corpus: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(lexeme, df)`` plus the corpus size, one aggregation each."""
    return (lexemes(corpus, key, text).select(key, "lexeme").distinct()
            .groupBy("lexeme").agg(F.count(F.lit(1)).alias("df")))


MAX_QUESTION_LEXEMES = 2_000_000


def refined_terms(questions: DataFrame, corpus: DataFrame, k: int = 5, key: str = "doc_id",
                  text: str = "text") -> DataFrame:
    """``(query_id, term_rank, term, idf)`` for ``questions (query_id, query_text)``.

    Document frequencies are computed for the question lexemes only: a
    broadcast semi-join (size checked) that Catalyst pushes below the
    per-document distinct and the count, right after the tokenizer."""
    n_docs = corpus.count()  # one scalar, attached as a literal
    q = lexemes(questions, "query_id", "query_text").select("query_id", "lexeme").distinct()
    vocab = q.select("lexeme").distinct()
    # broadcast only a vocabulary of checked size; beyond it a shuffle semi-join
    small = vocab.limit(MAX_QUESTION_LEXEMES + 1).count() <= MAX_QUESTION_LEXEMES
    dfs = document_frequencies(corpus, key, text).join(F.broadcast(vocab) if small else vocab,
                                                       "lexeme", "left_semi")
    scored = (q.join(dfs, "lexeme", "left")
              .withColumn("idf", F.log(F.lit(1.0 + n_docs) / (F.lit(1.0) + F.coalesce("df", F.lit(0))))))
    w = Window.partitionBy("query_id").orderBy(F.col("idf").desc(), F.col("lexeme"))
    return (scored.withColumn("term_rank", F.row_number().over(w)).where(F.col("term_rank") <= k)
            .select("query_id", "term_rank", F.col("lexeme").alias("term"), "idf"))


MAX_WORDS, MIN_COUNT = 3, 2
#: A word, or one sign that ends a run of words.
RUN_TOKEN = r"[\p{L}\p{N}]+|[^\p{L}\p{N} \t\n\r\f\x0B]"


def _expressions(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, n, expression, at, surface)``: every run of 1 to ``MAX_WORDS`` kept words."""
    rows = df.select(F.col(key), F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(RUN_TOKEN), F.lit(0)).alias("t"))
    plain = F.transform("t", lambda w: F.lower(w))
    kept = F.transform("plain", lambda w: w.rlike(r"^[\p{L}\p{N}]") & ~w.isin(list(FRENCH)))
    rows = rows.withColumn("plain", plain).withColumn("kept", kept)

    def of(n: int) -> Column:
        places = F.when(F.size("t") >= n, F.sequence(F.lit(0), F.size("t") - n)).otherwise(F.array().cast("array<int>"))
        whole = F.filter(places, lambda i: F.forall(F.slice("kept", i + 1, n), lambda k: k))

        return F.transform(whole, lambda i: F.struct(
            F.lit(n).alias("n"), F.array_join(F.slice("plain", i + 1, n), " ").alias("expression"), i.alias("at"),
            F.array_join(F.slice("t", i + 1, n), " ").alias("surface")))

    parts = [of(n) for n in range(1, MAX_WORDS + 1)]
    return rows.select(key, F.explode(F.concat(*parts)).alias("e")).select(key, "e.*")


def _corpus_expressions(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, expression)`` of every run of 1 to ``MAX_WORDS`` kept words.  Signs become one
    mark, marks and stop words NULL, and joining with NULL is NULL, so no run crosses them."""
    marked = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[^\p{L}\p{N} \t\n\r\f\x0B]+", " \u0001 ")
    plain = F.transform(F.split(marked, r"[ \t\n\r\f\x0B]+"), lambda w: F.lower(w))
    kept = F.transform(plain, lambda w: F.when(~w.isin("", "\u0001", *FRENCH), w))
    rows = df.select(F.col(key), kept.alias("u1"))
    for n in range(2, MAX_WORDS + 1):  # places line up: run i of n words starts at word i
        rows = rows.withColumn(f"u{n}", F.zip_with(f"u{n - 1}", F.slice("u1", n, 1 << 30), lambda a, b: F.concat(a, F.lit(" "), b)))
    every = F.concat(*[F.filter(f"u{n}", lambda e: e.isNotNull()) for n in range(1, MAX_WORDS + 1)])
    return rows.select(key, F.explode(every).alias("expression"))


def key_expressions(questions: DataFrame, corpus: DataFrame, k: int = 5, key: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """``(query_id, term_rank, term, n_words, score)`` for ``questions (query_id,
    query_text)``: the first ``k`` key expressions, written as they stand in the question
    (first place).  Only expressions of the questions are counted in the corpus.

    Defined cases: a question without a kept word has no expression; NULL texts are empty;
    a corpus without documents counts nothing, and only names stand as several words."""
    n_docs = corpus.count()  # one scalar, attached as a literal
    found = (_expressions(questions, "query_id", "query_text").groupBy("query_id", "n", "expression")
             .agg(F.min(F.struct("at", "surface")).alias("first")))
    wanted = found.select("expression").distinct()
    small = wanted.limit(MAX_QUESTION_LEXEMES + 1).count() <= MAX_QUESTION_LEXEMES
    counts = (_corpus_expressions(corpus, key, text).join(F.broadcast(wanted) if small else wanted, "expression", "left_semi")
              .groupBy("expression", key).count().groupBy("expression").agg(F.sum("count").alias("f"), F.count("*").alias("df")))
    scored = found.join(counts, "expression", "left").select(
        "query_id", "n", "expression", F.col("first.at").alias("at"), F.col("first.surface").alias("surface"),
        (F.coalesce("f", F.lit(0)) + 1).alias("f1"),
        F.log(F.lit(1.0 + n_docs) / (F.lit(1.0) + F.coalesce("df", F.lit(0)))).alias("idf"))
    name = F.forall(F.split("surface", " "), lambda w: w.rlike(r"^\p{Lu}"))
    scored = scored.where((F.col("n") == 1) | (F.col("f1") > MIN_COUNT) | name)
    # used twice below: a few rows a question word, written once
    path = scratch_path(questions.sparkSession, "expressions")
    scored.write.parquet(path)
    scored = questions.sparkSession.read.schema(scored.schema).parquet(path)
    # every standing expression tells its parts; a question's expressions are as many as its words
    words = F.split("expression", " ")

    def inner(m: int) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.col("n") - m), lambda i: F.array_join(F.slice(words, i + 1, m), " "))
        return F.when(F.col("n") > m, runs).otherwise(F.array().cast("array<string>"))

    around = (scored.where("n > 1").select("query_id", "f1", F.explode(F.array_distinct(F.concat(*[inner(m) for m in range(1, MAX_WORDS)]))).alias("expression"))
              .groupBy("query_id", "expression").agg(F.avg("f1").alias("around")))
    left = scored.join(around, ["query_id", "expression"], "left").where("around IS NULL OR f1 > around")
    score = F.log2(F.col("n") + F.lit(1.0)) * F.col("idf")
    w = Window.partitionBy("query_id").orderBy(F.round(score, 9).desc(), "at", F.col("n").desc(), "expression")
    return (left.select("query_id", F.row_number().over(w).alias("term_rank"), F.col("surface").alias("term"),
                        F.col("n").alias("n_words"), score.alias("score")).where(F.col("term_rank") <= k))
