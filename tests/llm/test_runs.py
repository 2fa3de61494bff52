"""Periodic runs: Lyndon arrays and runs against brute force, the registered digest."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from quarry.llm import queries
from quarry.llm import runs as R

SF = "/root/testdata/sf0.001"


def lyndon_brute(x):
    out = []
    for i in range(len(x)):
        j = i + 1
        while j < len(x) and x[j:] > x[i:]:  # up to the next smaller suffix
            j += 1
        out.append(j - i)
    return out


def runs_brute(x, min_words=24, min_periods=3):
    """By every period: maximal stretches of equal words one period apart."""
    n, out = len(x), set()
    for q in range(1, n // min_periods + 1):
        i = 0
        while i + q < n:
            if x[i] != x[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and x[i] == x[i + q]:
                i += 1
            length, part = i + q - s, x[s:i + q]
            if length >= max(min_words, min_periods * q) and not any(
                    q % p == 0 and part[p:] == part[:-p] for p in range(1, q)):
                out.add((s, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def rows(a):
    return [tuple(r) for r in a.tolist()]


def test_lyndon_arrays():
    rng = random.Random(1)
    for _ in range(1500):
        x = [rng.randrange(rng.randint(1, 4)) for _ in range(rng.randint(1, 40))]
        assert R.lyndon_array(x) == lyndon_brute(x)
        y = [-v for v in x]
        assert R.lyndon_array(y) == lyndon_brute(y)
    assert R.lyndon_array([]) == []
    assert R.lyndon_array(list(b"banana")) == [1, 2, 1, 2, 1, 1]


@pytest.mark.parametrize("least", [(2, 2), (6, 3), (8, 2), (9, 4), (24, 3)])
def test_runs_of_sequences(least):
    rng = random.Random(2)
    for _ in range(400):
        x = []
        for _ in range(rng.randint(0, 4)):
            x += [rng.randrange(3) for _ in range(rng.randint(1, 6))] * rng.randint(1, 6)
        assert rows(R.find_runs(np.array(x, np.int64), *least)) == runs_brute(x, *least)


@pytest.mark.parametrize("least", [(2, 2), (6, 3), (24, 3), (10, 2), (30, 5)])
def test_stretches_lose_no_run(least):
    """Texts of a batch, searched in their repeated stretches only."""
    rng = random.Random(4)
    for _ in range(150):
        texts = []
        for _ in range(rng.randint(1, 5)):
            words = []
            for _ in range(rng.randint(0, 5)):
                words += [b"%d" % rng.randrange(4) for _ in range(rng.randint(1, 9))] * rng.randint(1, 8)
                words += [b"x%d" % rng.randrange(50) for _ in range(rng.randint(0, 12))]
            texts.append(words)
        got = R.runs_of(texts, *least)
        for k, words in enumerate(texts):
            assert rows(got.get(k, np.zeros((0, 3)))) == runs_brute(words, *least)


def test_window():
    assert R.window(24, 3) == 9
    for least in [(24, 3), (6, 3), (10, 4), (2, 2)]:
        for q in range(1, 40):
            for length in range(max(least[0], least[1] * q), least[1] * q + 40):
                assert length >= 2 * q + R.window(*least) - 1


def test_long_sequences_are_fast():
    for x in (np.zeros(60_000), np.arange(60_000) % 13, np.tile(np.arange(20_000), 3)):
        assert rows(R.find_runs(x.astype(np.int64))) == [(0, 60_000, {1: 1, 13: 13, 20_000: 20_000}[len(np.unique(x))])]


EDGES = [(1, None), (2, ""), (3, " \n\t "), (4, "a " * 23), (5, "a " * 24), (6, "x " + "a b " * 12 + "c"), (6, "x " + "a b " * 12 + "c"),
         (None, "q r s " * 10), (7, "a\tb\nc\x0bd\x0ce\rf " * 6 + " end"), (8, "a b c d " * 12), (9, "w%d " * 30), (10, "0 1 " * 20 + "0 1 2 " * 20),
         (11, "lorem ipsum dolor " * 30_000), (12, "x" * 200_000)]


def expected(doc_id, text):
    words = (text or "").encode().split()
    found = runs_brute([w.decode() for w in words]) if len(words) < 50_000 else None
    dropped = set()
    for s, n, q in found or []:
        dropped.update(range(s + q, s + n))
    return words, found, b" ".join(w for k, w in enumerate(words) if k not in dropped).decode()


def test_operator_edges(spark):
    df = spark.createDataFrame([(*e, 1, "y") for e in EDGES], "doc_id long, text string, runs int, collapsed string")
    got = sorted(R.periodic_runs(df).collect(), key=repr)
    want = []
    for doc_id, text in EDGES:
        words, found, kept = expected(doc_id, text)
        if found is None:
            found, kept = [(0, 90_000, 3)], "lorem ipsum dolor"
        want.append((doc_id, len(words), found, kept))
    assert sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got), key=repr) == sorted(want, key=repr)
    assert R.periodic_runs(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        R.periodic_runs(df, min_periods=1)


def test_query_equals_brute_force(spark):
    t = pq.read_table(f"{SF}/documents.parquet").to_pydict()
    want = {}
    for doc_id, text in zip(t["doc_id"], t["text"]):
        words = [w.decode() for w in (text or "").encode().split()]
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        # long texts by brute force only where three equal words one period apart can occur
        found = runs_brute(words) if n < 2_500 else rows(R.find_runs(np.unique(words, return_inverse=True)[1]))
        dropped = set()
        for s, length, q in found:
            dropped.update(range(s + q, s + length))
        best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2])) if found else (None,) * 3
        want[doc_id] = (len(found), *best, found and 1000 * best[1] // best[2] or None,
                        hashlib.sha256("".join(f"{s},{k},{q}\n" for s, k, q in found).encode()).hexdigest(),
                        hashlib.sha256(" ".join(w for k, w in enumerate(words) if k not in dropped).encode()).hexdigest())
    got = {r.doc_id: tuple(r)[1:] for r in queries.op13_periodic_runs(spark, SF).collect()}
    assert got == want
    assert sum(v[0] for v in want.values()) > 10
