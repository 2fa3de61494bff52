"""Factorization machines: the linear-time identity, learning pairs, held-out accuracy, edges."""

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from quarry.llm import fm, quality_classifier, toxicity

SF = "/root/testdata/sf0.01"


def test_margin_is_the_pair_sum():
    rng = np.random.default_rng(2)
    place = np.arange(-1, 29)
    m = fm.Machine(place, 0.3, rng.normal(size=29), rng.normal(size=(29, 4)))
    rows = [[], [0], [1, 2, 3], [5, 9, 28, 7], [4]]
    got = m.score(pa.array(rows, pa.list_(pa.int32())))
    for r, s in zip(rows, got):
        x = [place[b] for b in r if place[b] >= 0]
        z = 0.3 + sum(m.w[i] for i in x) + sum(m.v[a] @ m.v[b] for k, a in enumerate(x) for b in x[:k])
        assert abs(s - 1 / (1 + np.exp(-z))) < 1e-9


def test_learns_a_pair():
    """Label 1 only where features 0 and 1 meet: no linear weights can tell."""
    rng = np.random.default_rng(3)
    rows = [sorted(set(rng.choice(2, rng.integers(0, 3), replace=False)) | set(rng.integers(2, 20, 4))) for _ in range(4000)]
    y = np.array([float(0 in r and 1 in r) for r in rows])
    feature = np.concatenate(rows).astype(np.int64)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    m = fm.fit_machine(np.arange(20), feature, row, y)
    p = 1 / (1 + np.exp(-m.margin(feature, row, len(rows))))
    assert np.mean((p > 0.5) == y) > 0.97


@pytest.mark.parametrize("module,label,mod,rest,threshold,accuracy", [
    (toxicity, "toxic", 3, 1, 0.7, 0.85), (quality_classifier, "quality", 5, 0, 0.3, 0.93)])
def test_held_out_accuracy(spark, module, label, mod, rest, threshold, accuracy):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    run = module.toxicity if module is toxicity else module.quality
    rows = run(docs, labels).collect()
    truth = {r["doc_id"]: r[label] for r in labels.collect()}
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in docs.select("doc_id").collect())
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % mod == rest)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= threshold)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > accuracy
    # labels of held-out rows play no part
    flipped = labels.selectExpr("doc_id", f"IF(crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % {mod} = {rest}, "
                                f"1 - {label}, {label}) AS {label}")
    other = {r.doc_id: r.score for r in run(docs, flipped).collect()}
    assert all(other[r.doc_id] == r.score for r in rows)


@pytest.mark.parametrize("module", [toxicity, quality_classifier])
def test_edges(spark, module):
    run, label = (module.toxicity, "toxic") if module is toxicity else (module.quality, "quality")
    rows = [(k, f"plain words number {k} here") for k in range(40)] + [(100 + k, f"vile words number {k}") for k in range(40)]
    rows += [(None, None), (None, ""), (7, "plain words number 7 here"), (500, "w " * 40_000)]
    docs = spark.createDataFrame([(*r, "a", "b") for r in rows], "doc_id long, text string, x string, score string")
    labels = spark.createDataFrame([(k, int(k >= 100)) for k in range(140)] + [(None, 1), (3, None)], f"doc_id long, {label} int")
    got = run(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    same = {r.doc_id: set() for r in got}
    for r in got:
        same[r.doc_id].add(round(r.score, 12))
    assert len(same[7]) == 1
    held = [r for r in got if r.doc_id is not None and 100 <= r.doc_id < 140]
    assert np.mean([r.score for r in held]) > np.mean([r.score for r in got if r.doc_id is not None and r.doc_id < 40])
    assert run(docs.limit(0), labels).collect() == []
    assert len(run(docs, labels.limit(0)).collect()) == len(rows)
    assert len(run(docs, labels.where(f"{label} = 1")).collect()) == len(rows)


def test_without_toxic_keeps_rows_whole(spark):
    rows = [(k, f"plain words number {k} here", k) for k in range(60)] + [(100 + k, f"vile vile idiot {k}", k) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, x int")
    labels = spark.createDataFrame([(r[0], int(r[0] >= 100)) for r in rows], "doc_id long, toxic int")
    got = toxicity.without_toxic(docs, labels)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect())) == sorted(r for r in rows if r[0] < 100)


def test_a_pure_pair_through_the_whole_fit(spark):
    """Texts labelled by the meeting of two terms, each as common in both classes."""
    rng = np.random.default_rng(5)
    fill = [f"filler{k}" for k in range(60)]
    rows = []
    for k in range(4000):
        one, two = rng.random(2) < 0.5
        words = list(rng.choice(fill, 12)) + ["insult"] * bool(one) + ["group"] * bool(two)
        rng.shuffle(words)
        rows.append((k, " ".join(words), int(one == two)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    got = [r for r in toxicity.toxicity(docs, labels, threshold=0.5).collect() if r.held_out]
    assert np.mean([r.predicted == rows[r.doc_id][2] for r in got]) >= 0.95
