"""Co-occurrence vectors against a direct computation; neighbours of planted copies."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import embed as E
from quarry.operators.vector_search import vector_candidates


def brute(texts, dim=16, window=2, seed=3):
    """(word vectors, embeddings) of lists of words; '' is a stop word."""
    words = sorted({w for t in texts for w in t if w})
    sign = dict(zip(words, E.signs(words, dim, seed))) if words else {}
    vec, df = {w: np.zeros(dim) for w in words}, {w: 0 for w in words}
    for t in texts:
        for w in set(t) - {""}:
            df[w] += 1
        for i, w in enumerate(t):
            for j in range(max(0, i - window), min(len(t), i + window + 1)):
                if w and j != i and t[j]:
                    vec[w] += sign[t[j]]
    out = []
    for t in texts:
        total = np.zeros(dim)
        for w in t:
            if w and np.linalg.norm(vec[w]) > 0:
                total += vec[w] / np.linalg.norm(vec[w]) * (np.log1p(len(texts)) - np.log1p(df[w]))
        out.append(total / np.linalg.norm(total) if np.linalg.norm(total) > 1e-12 else None)
    return vec, df, out


@pytest.mark.parametrize("frequent", [0, 5])
def test_equals_direct_computation(spark, frequent, monkeypatch):
    monkeypatch.setattr(E, "SLICE", 40)
    monkeypatch.setattr(E, "FLUSH", 7)
    rng = random.Random(1)
    lists = [[rng.choice([f"w{k}" for k in range(12)] + [""]) for _ in range(rng.randint(0, 25))] for _ in range(40)]
    lists += [[], [""], ["lonely"], ["w1"] * 300]
    rows = [(k, " ".join(w or "le" for w in t) if t else None, 1.0) for k, t in enumerate(lists)]
    df = spark.createDataFrame(rows, "id long, content string, embedding double").repartition(3)
    model = E.WordVectors.fit(df, text_col="content", dimensions=16, seed=3)
    vec, dfs, want = brute(lists)
    got = {r.word: r for r in model.words.collect()}
    assert set(got) == set(vec)
    for w, r in got.items():
        assert r.df == dfs[w] and r.n == sum(t.count(w) for t in lists)
        assert np.array_equal(np.frombuffer(bytes(r.vector)), vec[w])
    for r in model.embed(df, frequent=frequent).collect():
        if want[r.id] is None:
            assert r.embedding is None
        else:
            assert np.allclose(r.embedding, want[r.id], atol=1e-5)


def test_copies_are_nearest(spark):
    rng = random.Random(2)
    words = [f"v{k}" for k in range(400)]
    texts = [" ".join(rng.choice(words[20 * (k % 20):20 * (k % 20) + 40]) for _ in range(60)) for k in range(60)]
    near = []
    for k in range(10):  # a twentieth of the words replaced
        t = texts[k].split()
        for i in range(0, 60, 20):
            t[i] = rng.choice(words)
        near.append(" ".join(t))
    df = spark.createDataFrame([(str(k), t) for k, t in enumerate(texts + near)] + [("none", None)], "id string, content string")
    model = E.WordVectors.fit(df, text_col="content")
    vectors = model.embed(df)
    asked = vectors.where(F.expr("try_cast(id AS INT) >= 60")).select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vec"))
    found = {(r.query_id, r.id) for r in vector_candidates(vectors, asked, 2).collect()}
    assert all((str(60 + k), str(k)) in found for k in range(10))
    assert model.embed(df.limit(0)).collect() == []


def test_empty_corpus(spark):
    df = spark.createDataFrame([], "id string, content string")
    model = E.WordVectors.fit(df, text_col="content")
    one = spark.createDataFrame([("a", "some words")], "id string, content string")
    assert model.words.count() == 0 and [r.embedding for r in model.embed(one).collect()] == [None]


def test_rare_words_travel_as_small_whole_numbers(spark):
    texts = [f"common word{k} other{k}" for k in range(50)] + ["common " * 200]
    df = spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "id string, content string").repartition(5)
    model = E.WordVectors.fit(df, text_col="content", dimensions=16)
    widths = {r.word: len(r.vector) // 16 for r in model.stored.collect()}
    assert widths.pop("common") == 2 and set(widths.values()) == {1} and len(widths) == 100
    assert model.least_df(0) is None and model.least_df(1) == model.least_df(99) == 51 and model.least_df(101) == 1


def test_sums_go_on_over_batches():
    import pyarrow as pa

    wide = np.array([[1.0, -2.0], [127.0, 1.0], [1.0, 0.0], [2.0 ** 40, 0.0], [0.5, 0.0], [-1.0, 3.0]])
    rows = pa.RecordBatch.from_arrays([pa.array(["a", "a", "a", "b", "c", "c"]), pa.array([1] * 6), pa.array([1] * 6),
                                       pa.array(E._packed(wide), pa.binary())], ["word", "n", "df", "vector"])
    for step in (1, 2, 4, 6):
        out = pa.Table.from_batches(E._summed(2)(rows.slice(k, step) for k in range(0, 6, step))).to_pydict()
        assert out["word"] == ["a", "b", "c"] and out["n"] == out["df"] == [3, 1, 2]
        assert np.array_equal(E._unpacked(pa.array(out["vector"]), 2), [[129.0, -1.0], [2.0 ** 40, 0.0], [-0.5, 3.0]])
