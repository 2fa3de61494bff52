"""The saved postings index: equal to the lazy search, bounds that skip, French stems."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.functions.french import stem
from quarry.operators import postings as P
from quarry.operators.text_search import LexemeIndex, text_matches, text_search
from quarry.session import scratch_path

# the sample vocabulary of the published description of the stemmer
STEMS = """continu continu continua continu continuait continu continuant continu continuation continu continue continu
continué continu continuel continuel continuelle continuel continuellement continuel continuelles continuel
continuels continuel continuer continu continuera continu continuerait continu continueront continu continuez continu
continuité continu continuons continuon contorsions contors contour contour contournait contourn contournant contourn
contourne contourn contours contour contractait contract contracté contract contractée contract contracter contract
contractés contract contractions contract contradictoirement contradictoir contradictoires contradictoir
contraindre contraindr contraint contraint contrainte contraint contraintes contraint contraire contrair
contraires contrair contraria contrari main main mains main maintenaient mainten maintenait mainten maintenant mainten
maintenir mainten maintenue maintenu maintien maintien maintint maintint maire mair maires mair mairie mair mais mais
maïs maï maison maison maisons maison maistre maistr maitre maitr maître maîtr maîtres maîtr maîtresse maîtress
maîtresses maîtress majesté majest majestueuse majestu majestueusement majestu majestueux majestu majeur majeur
majeure majeur major major majordome majordom majordomes majordom majorité major majorités major mal mal
malacca malacc malade malad malades malad maladie malad maladies malad maladive malad""".split()


def test_published_stems():
    assert {w: stem(w) for w in STEMS[::2]} == dict(zip(STEMS[::2], STEMS[1::2]))


def test_stems_equal_the_sql_map():
    import duckdb
    import pyarrow as pa

    from quarry.functions import french as R
    from quarry.plans.french_sql import stem_ctes
    rng = random.Random(1)
    ends = [x.replace("I", "i").replace("U", "u") for x in (*R.STEP1, *R.STEP2A, *R.STEP2B, *R.STEP4, *R.DOUBLES, "s", "ïs")]
    begins = "a e i o u y é è b c qu n t ss ic at iv abil eus abl iqu ièr par ï ë ç".split()
    words = set(STEMS) | {"".join(rng.choice(begins) for _ in range(rng.randint(0, 4))) + rng.choice(ends) for _ in range(5000)}
    con = duckdb.connect()
    con.register("vocabulary", pa.table({"w": sorted(words)}))
    got = con.execute(f"WITH {stem_ctes('vocabulary')} SELECT w, stem FROM stems").fetchall()
    assert dict(got) == {w: stem(w) for w in words}


def test_stems_of_odd_words():
    assert [stem(w) for w in ["", "a", "é", "y", "123", "слово", "x" * 500, "qu", "mangeront", "première", "nationaux"]] == [
        "", "a", "é", "y", "123", "слово", "x" * 500, "qu", "mang", "premi", "national"]


def _corpus(spark, n, seed, words=12, long=40):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(words)]
    return [(f"d{k:04d}", " ".join(rng.choices(vocabulary, weights=[1 / (j + 1) for j in range(words)], k=rng.randint(0, long))))
            for k in range(n)]


def _rows(df):
    return sorted((r.query_id, r.id, round(r.text_score, 9), r.text_rank) for r in df.collect())


@pytest.mark.parametrize("k", [None, 3])
@pytest.mark.parametrize("norm", [False, True])
def test_equals_the_lazy_search(spark, k, norm):
    rows = _corpus(spark, 400, 1) + [("null", None), ("empty", ""), ("long", "w0 w1 " * 3000), ("same1", "w1 w2 w3"), ("same0", "w1 w2 w3")]
    recs = spark.createDataFrame(rows, "id string, content string")
    qs = spark.createDataFrame([(1, "w0"), (2, "w3 w1"), (3, "W2, w2 w5 w0!"), (4, "w11 w10 w9 w8"), (5, "unknown w1"), (6, "le la"), (7, None),
                                (8, ""), (9, "w0 w1 w2 w3 w4 w5")], "query_id int, query_text string")
    index = P.PostingsIndex.save(recs, scratch_path(spark, "test-postings"), groups=7)
    got = index.search(qs, k, length_norm=norm)
    want = text_search(recs.where("content IS NOT NULL"), qs.where("query_text IS NOT NULL"), k, length_norm=norm)
    assert _rows(got) == _rows(want)
    assert sorted(map(tuple, text_matches(index, qs).collect())) == sorted(
        map(tuple, text_matches(LexemeIndex.build(recs.where("content IS NOT NULL")), qs.where("query_text IS NOT NULL")).collect()))
    only = recs.where("id < 'd0200'").select("id")
    assert _rows(index.search(qs, k, length_norm=norm, only=only)) == _rows(
        text_search(recs.join(only, "id", "left_semi"), qs.where("query_text IS NOT NULL"), k, length_norm=norm))


@pytest.mark.parametrize("norm", [False, True])
def test_bounds_skip_groups_and_lose_nothing(spark, norm, monkeypatch):
    """A few records score high; groups without one are not read in the second round."""
    monkeypatch.setattr(P, "FIRST", 16)
    rows = [(f"d{k:04d}", "alpha filler beta" if k % 50 else "alpha beta " * 30) for k in range(1000)]
    recs = spark.createDataFrame(rows, "id string, content string")
    qs = spark.createDataFrame([(1, "alpha beta"), (2, "filler alpha")], "query_id int, query_text string")
    index = P.PostingsIndex.save(recs, scratch_path(spark, "test-postings"), groups=64)
    read = []
    scored = P.PostingsIndex._score

    def watched(self, terms, longest, pairs, length_norm):
        read.append(64 if pairs is None else pairs.where("query_id = 1").count())
        return scored(self, terms, longest, pairs, length_norm)

    monkeypatch.setattr(P.PostingsIndex, "_score", watched)
    got = _rows(index.search(qs, 3, length_norm=norm))
    assert got == _rows(text_search(recs, qs, 3, length_norm=norm))
    assert len(read) == 2 and read[0] + read[1] < 30  # of 64 groups that hold both words


def test_large_batches_and_joins(spark, monkeypatch):
    recs = spark.createDataFrame(_corpus(spark, 120, 3), "id string, content string")
    qs = spark.createDataFrame([(j, f"w{j % 5} w{j % 3}") for j in range(30)], "query_id int, query_text string")
    index = P.PostingsIndex.save(recs, scratch_path(spark, "test-postings"), groups=5)
    want = _rows(text_search(recs, qs, 4))
    monkeypatch.setattr(P, "MAX_BROADCAST_ROWS", 20)
    monkeypatch.setattr(P, "FIRST", 1)
    assert _rows(index.search(qs, 4)) == want


def test_index_holds_no_token_arrays(spark):
    recs = spark.createDataFrame(_corpus(spark, 50, 4), "id string, content string")
    path = scratch_path(spark, "test-postings")
    index = P.PostingsIndex.save(recs, path, groups=3)
    assert index.blocks.groupBy("lexeme", "grp").count().where("count > 1").count() == 0
    df = index.search(spark.createDataFrame([(1, "w1 w2")], "query_id int, query_text string"), 5)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "tokens" not in plan and "content" not in plan
    assert {r.lexeme: r.df for r in index.stats.collect()} == {
        r.lexeme: r.df for r in recs.select("id", F.explode(F.split("content", " ")).alias("lexeme")).where("lexeme <> ''")
        .groupBy("lexeme").agg(F.countDistinct("id").alias("df")).collect()}


def test_stemmed_search(spark):
    recs = spark.createDataFrame([("1", "Les continuités majestueuses mangeront"), ("2", "continuer"), ("3", "autre chose"),
                                  ("4", "majestueux, il continue ; manger")], "id string, content string")
    qs = spark.createDataFrame([(1, "continuellement"), (2, "continué majestueusement"), (3, "mange majestueuse continuons")],
                               "query_id int, query_text string")
    index = P.PostingsIndex.save(recs, scratch_path(spark, "test-postings"), stemmer=stem, groups=2)
    found = {}
    for r in index.matches(qs).collect():
        found.setdefault(r.query_id, set()).add(r.id)
    assert found == {2: {"1", "4"}}  # "continuel" and "continuon" are stems of their own
    again = spark.createDataFrame([(1, "continuité"), (2, "mangeait")], "query_id int, query_text string")
    assert sorted((r.query_id, r.id) for r in index.search(again, 9).collect()) == [(1, "1"), (1, "2"), (1, "4"), (2, "1"), (2, "4")]


def test_empty_table(spark):
    recs = spark.createDataFrame([], "id string, content string")
    index = P.PostingsIndex.save(recs, scratch_path(spark, "test-postings"))
    qs = spark.createDataFrame([(1, "a")], "query_id int, query_text string")
    assert index.search(qs, 3).collect() == [] and index.matches(qs.limit(0)).collect() == []


def test_a_long_batch_moves_only_the_blocks_it_asks_for(spark, tmp_path, monkeypatch):
    """Beyond the broadcast bounds the blocks are cut by lexeme and group before the join."""
    from pyspark.sql import functions as F

    from quarry.operators import postings
    from quarry.operators.text_search import LexemeIndex, text_matches, text_search

    rows = [(str(k), f"alpha beta {'gamma ' * (k % 4)}word{k % 10} only{k}") for k in range(200)]
    recs = spark.createDataFrame(rows, "id string, content string")
    asked = spark.createDataFrame([(1, "alpha gamma"), (2, "word3 beta"), (3, "gamma nowhere"), (4, "only17")], "query_id int, query_text string")
    index = postings.PostingsIndex.save(recs, str(tmp_path / "ix"), groups=8)
    want = {k: sorted(map(tuple, text_search(recs, asked, k).select("query_id", "id", F.round("text_score", 9)).collect())) for k in (3, 0)}
    for bound in (500, 10):  # a small batch of long lists; a batch too long to be read
        monkeypatch.setattr(postings, "MAX_BROADCAST_ROWS", bound)
        for k in (3, 0):
            got = index.search(asked, k)
            assert sorted(map(tuple, got.select("query_id", "id", F.round("text_score", 9)).collect())) == want[k]
        found = index.matches(asked)
        assert "LeftSemi" in found._jdf.queryExecution().optimizedPlan().toString()
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, text_matches(LexemeIndex.build(recs), asked).collect()))
