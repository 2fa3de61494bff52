"""Vector, text and hybrid search on hand-made rows (FIXTURES.md D1-D3, D12)."""

import math

import pytest
from pyspark.sql import functions as F

from quarry.operators.fusion import fuse
from quarry.operators.text_search import text_search
from quarry.operators.vector_search import vector_candidates, vector_search


def _fuse_rows(spark, vec, txt, mode, missing="postgres"):
    v = spark.createDataFrame(vec, "query_id int, id string, vec_score double")
    t = spark.createDataFrame(txt, "query_id int, id string, text_score double")
    out = fuse(v, t, 10, mode, missing=missing).orderBy("rank").collect()
    return [(r.id, r.score) for r in out]


def test_rrf_postgres_null_order(spark):
    # a: vec 1, text NULL; b: vec 2, text 5; c: vec NULL, text 7  (vector score = distance)
    vec = [(1, "a", 1.0), (1, "b", 2.0)]
    txt = [(1, "b", 5.0), (1, "c", 7.0)]
    out = _fuse_rows(spark, vec, txt, "rrf")
    assert [i for i, _ in out] == ["a", "c", "b"]
    s = dict(out)
    assert math.isclose(s["a"], 1 / 61 + 1 / 31)
    assert math.isclose(s["b"], 1 / 62 + 1 / 33)
    assert math.isclose(s["c"], 1 / 63 + 1 / 32)


def test_rrf_classic(spark):
    vec = [(1, "a", 1.0), (1, "b", 2.0)]
    txt = [(1, "b", 5.0), (1, "c", 7.0)]
    out = _fuse_rows(spark, vec, txt, "rrf", missing="classic")
    assert [i for i, _ in out] == ["b", "c", "a"]
    s = dict(out)
    assert math.isclose(s["a"], 1 / 61) and math.isclose(s["b"], 1 / 62 + 1 / 32)
    assert math.isclose(s["c"], 1 / 31)


def test_max_norm(spark):
    out = dict(_fuse_rows(spark, [(1, "a", .8), (1, "b", .4)], [(1, "b", .2), (1, "c", .1)], "max_norm"))
    assert out == pytest.approx({"a": 1.0, "b": 1.5, "c": 0.5})


def test_fusion_limits(spark):
    v = spark.createDataFrame([(1, "a", 1.0)], "query_id int, id string, vec_score double")
    t = spark.createDataFrame([], "query_id int, id string, text_score double")
    assert fuse(v, t, 0).count() == 0
    with pytest.raises(ValueError):
        fuse(v, t, -1)


@pytest.mark.parametrize("text,query,score", [
    ("alpha beta alpha gamma alpha", "alpha", 0.3),
    ("alpha beta gamma", "alpha beta", 0.1),
    ("alpha xx beta", "alpha beta", 0.05),
])
def test_cover_density(spark, text, query, score):
    recs = spark.createDataFrame([("r1", text)], "id string, content string")
    qs = spark.createDataFrame([(1, query)], "query_id int, query_text string")
    out = text_search(recs, qs).collect()
    assert len(out) == 1 and out[0].text_score == pytest.approx(score)


def test_text_and_semantics_and_stop_words(spark):
    recs = spark.createDataFrame([("r1", "le chat noir"), ("r2", "le chien")], "id string, content string")
    qs = spark.createDataFrame([(1, "chat noir"), (2, "le la les"), (3, "chat chien")],
                               "query_id int, query_text string")
    out = {(r.query_id, r.id) for r in text_search(recs, qs).collect()}
    assert out == {(1, "r1")}


def test_vector_search_threshold_and_ties(spark):
    recs = spark.createDataFrame(
        [("a", [1.0, 0.0], ["k:1"], "x", "{}"), ("b", [1.0, 0.0], ["k:2"], "y", "{}"),
         ("c", [0.0, 1.0], ["k:1"], "z", "{}"), ("d", None, ["k:1"], "w", "{}")],
        "id string, embedding array<float>, tags array<string>, content string, payload string")
    qs = spark.createDataFrame([(7, [2.0, 0.0])], "query_id int, query_vec array<float>")
    top = [(r.id, r.rank) for r in vector_search(recs, qs, 2).orderBy("rank").collect()]
    assert top == [("a", 1), ("b", 2)]
    thr = {r.id for r in vector_search(recs, qs, 0, min_similarity=0.5).collect()}
    assert thr == {"a", "b"}
    filt = {r.id for r in vector_search(recs, qs, 5, filters=[["k:1"]]).collect()}
    assert filt == {"a", "c"}
    page = [r.id for r in vector_search(recs, qs, 1, offset=1).collect()]
    assert page == ["b"]


def test_vector_blocked_path_matches_broadcast(spark):
    import random
    rnd = random.Random(1)
    recs = spark.createDataFrame([(str(i), [rnd.uniform(-1, 1) for _ in range(8)]) for i in range(300)],
                                 "id string, embedding array<float>")
    qs = spark.createDataFrame([(j, [rnd.uniform(-1, 1) for _ in range(8)]) for j in range(7)],
                               "query_id int, query_vec array<float>")
    a = {(r.query_id, r.id, r.rank) for r in vector_candidates(recs, qs, 4).collect()}
    # several query blocks and many partitions give the same rows
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        b = {(r.query_id, r.id, r.rank)
             for r in vector_candidates(recs, qs, 4, max_broadcast_queries=3).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert a == b and len(a) == 28


def test_projections_and_custom_order(spark):
    from quarry.operators.fusion import hybrid_search
    from quarry.operators.store import list_records
    recs = spark.createDataFrame(
        [("a", [1.0, 0.0], ["k:1"], "alpha beta", '{"n": 2}'), ("b", [0.0, 1.0], ["k:1"], "beta", '{"n": 1}')],
        "id string, embedding array<float>, tags array<string>, content string, payload string")
    qs = spark.createDataFrame([(1, "beta", [1.0, 0.1])], "query_id int, query_text string, query_vec array<float>")
    assert "embedding" not in vector_search(recs, qs, 1).columns
    assert "embedding" in vector_search(recs, qs, 1, with_embeddings=True).columns
    out = hybrid_search(recs, qs, 2, "max_norm", with_records=True, with_embeddings=True).orderBy("rank").collect()
    assert [r.id for r in out] == ["a", "b"] and out[0].embedding == [1.0, 0.0]
    ordered = [r.id for r in list_records(recs, limit=0, order_by=F.get_json_object("payload", "$.n")).collect()]
    assert ordered == ["b", "a"]
    assert "embedding" in list_records(recs, with_embeddings=True).columns


def test_search_entry_and_judgements(spark):
    from quarry.operators.evaluate import attach_judgements, query_metrics, validate_labels
    from quarry.operators.fusion import search
    recs = spark.createDataFrame(
        [("a", [1.0, 0.0], ["lang:fr"], "chat noir", "{}"), ("b", [0.9, 0.1], ["lang:en"], "chat", "{}"),
         ("c", [0.0, 1.0], ["lang:fr"], "chien", "{}")],
        "id string, embedding array<float>, tags array<string>, content string, payload string")
    qs = spark.createDataFrame([(1, "chat", [1.0, 0.0])], "query_id int, query_text string, query_vec array<float>")
    ignored = {r.id for r in search(recs, qs, 3, filters=[["lang:fr"]]).collect()}
    assert ignored == {"a", "b", "c"}                      # filters accepted and ignored by default
    applied = {r.id for r in search(recs, qs, 3, filters=[["lang:fr"]], apply_filters=True).collect()}
    assert applied == {"a", "c"}
    res = search(recs, qs, 3, use_normalization=True).select("query_id", "rank", "id")
    labels = spark.createDataFrame([(1, 1, 3), (1, 2, 7)], "query_id int, rank int, is_relevant int")
    judged = attach_judgements(res, labels)
    assert {r.rank: r.is_relevant for r in judged.collect()} == {1: 3, 2: 7, 3: None}
    assert [r.is_relevant for r in validate_labels(judged).collect()] == [7]
    m = query_metrics(judged).collect()[0]
    assert m.n_results == 3 and m.ndcg == 0.0 and m.mrr == 1.0   # a NULL label zeroes nDCG
