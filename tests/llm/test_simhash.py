"""SimHash near-dedup against brute force."""

import random

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash

from quarry.llm import simhash

SF = "/root/testdata/sf0.001"


def brute_fp(text, n=3):
    w = (text or "").encode().lower().split()
    runs = [b" ".join(w[i:i + n]) for i in range(len(w) - n + 1)] or ([b" ".join(w)] if w else [])
    counts = [0] * 64
    for r in runs:
        h = xxhash.xxh64_intdigest(r, seed=42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(runs))


def brute_components(ids, fps, radius=3):
    parent = list(range(len(ids)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(ids))]


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string, size int")
    got = sorted(map(tuple, simhash.near_duplicates(df).collect()), key=repr)
    fps = [brute_fp(t) for _, t, *_ in rows]
    comps = brute_components([r[0] for r in rows], fps)
    want = sorted(((r[0], f"{f:016x}", c) for r, f, c in zip(rows, fps, comps)), key=repr)
    assert got == want


def test_whole_table(spark):
    t = pq.read_table(f"{SF}/documents.parquet").to_pydict()
    check(spark, [(i, x, None, None) for i, x in zip(t["doc_id"], t["text"])])


def test_edges(spark):
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one two"), (6, "ONE TWO"), (7, "É x y z"), (8, "é x y z"),
            (9, long), (9, long), (None, long), (None, "solo text here"), (10, "a\x0bb\x0cc d e"), (11, "a b c")]
    check(spark, [(*r, "x", 1) for r in rows])


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(df).collect() == []
    assert simhash.deduplicated(df).collect() == []


def test_deduplicated_keeps_one_of_each(spark):
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(3, text, "b"), (2, text, "a"), (2, text, "a"), (5, "quite another text of words", None),
            (None, text, "c"), (None, "only null ids here now", "d"), (7, None, "e"), (8, "", "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, __q_x string")
    got = sorted(((r.doc_id, r.text) for r in simhash.deduplicated(df).collect()), key=repr)
    assert got == sorted([(2, text), (5, "quite another text of words"), (None, "only null ids here now"), (7, None)],
                         key=repr)


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_links_find_every_component(spark, radius):
    """Random, chained and crowded fingerprints; small buckets force both splits."""
    rnd = random.Random(radius)
    values = {rnd.getrandbits(64) for _ in range(200)}
    seed = rnd.getrandbits(64)
    for _ in range(150):  # a chain: each within the radius of the one before
        values.add(seed)
        for b in rnd.sample(range(64), max(radius, 1)):
            seed ^= 1 << b
    values |= {rnd.getrandbits(14) << 50 for _ in range(300)}  # one crowded bucket
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    want = brute_components(list(range(len(values))), values, radius)
    for bucket_rows in (10_000, 24):
        got = {r.node: r.root for r in simhash.components(simhash.fingerprint_links(df, radius, bucket_rows)).collect()}
        groups = {}
        for i, v in enumerate(signed):
            groups.setdefault(got.get(v, v), set()).add(want[i])
        assert all(len(g) == 1 for g in groups.values())
        assert len(groups) == len(set(want))


def test_majority_of_long_lists():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 2**64, 5000, dtype=np.uint64)
    offsets = np.array([0, 0, 1, 3, 1300, 1300, 5000])
    got = simhash.majority_bits(h, offsets)
    for k in range(6):
        part = h[offsets[k]:offsets[k + 1]]
        want = sum(1 << b for b in range(64) if 2 * int(((part >> np.uint64(b)) & np.uint64(1)).sum()) > len(part))
        assert int(got[k]) == want
