"""Fair mixing: targets by brute force, nearness, repeats and edges."""

import math
import random

import pyarrow.parquet as pq
import pytest

from quarry.llm import mixing

SF = "/root/testdata/sf0.001"


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Fill by weight; what would pass a source's cap is shared again."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: weights[k % 3] for k, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), set(sizes), {}
    while open_:
        total = sum(w[s] for s in open_)
        capped = [s for s in open_ if left * w[s] / total >= most * sizes[s] - 1e-9]
        if not capped:
            out |= {s: left * w[s] / total for s in open_}
            break
        for s in capped:
            out[s] = most * sizes[s]
            open_.remove(s)
        left -= sum(out[s] for s in capped)
    return out


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size string, __q_copies int")
    got = mixing.mix_report(df).collect()
    again = mixing.mix_report(df.repartition(5)).collect()
    key = lambda r: repr(tuple(r))
    assert sorted(map(key, got)) == sorted(map(key, again))
    count = lambda t: len((t or "").encode().split())
    assert sorted((repr(r.doc_id), r.size) for r in got) == sorted((repr(r[0]), count(r[1])) for r in rows)
    sizes, taken, longest = {}, {}, {}
    for r in rows:
        sizes[r[2]] = sizes.get(r[2], 0) + count(r[1])
        longest[r[2]] = max(longest.get(r[2], 0), count(r[1]))
    want = brute_targets(sizes)
    for r in got:
        assert r.source_size == sizes[r.source]
        assert math.isclose(r.target, want[r.source], rel_tol=1e-9, abs_tol=1e-9)
        assert r.taken in (0, r.size, 2 * r.size)
        taken[r.source] = taken.get(r.source, 0) + r.taken
    budget = 1.5 * sum(sizes.values())
    assert sum(taken.values()) <= budget + 1e-9
    most = max(longest.values(), default=0)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= longest[s] + most * want[s] / max(budget, 1) + 1
    return got


def test_whole_table(spark):
    t = pq.read_table(f"{SF}/documents.parquet").to_pydict()
    check(spark, [(i, x, s, "c", 1) for i, x, s in zip(t["doc_id"], t["text"], t["source"])])


def test_edges(spark):
    rows = [(1, "a b c", "s1"), (1, "a b c", "s1"), (None, "x y", "s1"), (2, None, "s2"), (3, "", "s2"), (4, " \t", "s3"),
            (5, "w " * 40_000, "s4"), (6, "one two three", None), (7, "four five", None), (8, "z", "é")]
    rows += [(100 + k, "p q r s t " * 3, "hot") for k in range(300)]
    check(spark, [(*r, "x", 9) for r in rows])


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix_report(df).collect() == []
    assert mixing.mixed_documents(df).collect() == []


def test_documents_follow_the_report(spark):
    rows = [(k, f"text number {k} " * (k % 7), f"s{k % 5}") for k in range(60)] + [(90, "\t \n", "s1"), (91, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = sorted(r.doc_id for r in mixing.mix_report(df).collect() for _ in range(r.copies))
    got = mixing.mixed_documents(df)
    assert got.columns == df.columns
    assert sorted(r.doc_id for r in got.collect()) == want


@pytest.mark.parametrize("share,passes", [(0.5, 1), (1.0, 3), (4.0, 2)])
def test_other_budgets(spark, share, passes):
    rows = [(k, "w " * (1 + k % 9), f"s{k % 4}") for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_report(df, share=share, passes=passes).collect()
    total = sum(r.size for r in got)
    assert abs(sum(r.taken for r in got) - min(share, passes) * total) <= 9
    assert all(r.copies <= passes for r in got)


def whole_order(sizes, sources, share=1.5, passes=2):
    """Copies per row: every copy's finish time, all sorted, cut at the budget."""
    by = {s.source: s for s in sources}
    copies = []
    for source in by:
        queue = sorted((r for r in sizes if r.source == source and r["size"] > 0), key=lambda r: r.order)
        upto = 0
        for r in queue:
            upto += r["size"]
            copies += [((upto + p * by[source].source_size) / by[source].target, by[source]["rank"], r) for p in range(passes)]
    copies.sort(key=lambda c: c[:2])
    budget, run, out = math.floor(share * sum(r["size"] for r in sizes) + 1e-9), 0, {}
    for finish, rank, r in copies:
        run += r["size"]
        if run > budget:
            break
        out[r.doc_id] = out.get(r.doc_id, 0) + 1
    return out


@pytest.mark.parametrize("seed", [1])
def test_equals_the_whole_order(spark, seed, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_WORDS", 40)
    monkeypatch.setattr(mixing, "SLICES", 3)
    rng = random.Random(seed)
    rows = [(k, "w " * rng.choice([0, 1, 2, 9, rng.randint(1, 300)]), f"s{rng.choice([0, 0, 0, 1, 2, rng.randint(3, 30)])}") for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mix = mixing.fair_mix(df)
    want = whole_order(mix.sizes.collect(), mix.sources.collect())
    assert {r.doc_id: r.copies for r in mixing.mix_report(df).collect() if r.copies} == want


def test_a_document_far_above_its_target(spark):
    """Its copies finish late; the budget holds all the same."""
    rows = [(0, "w " * 400, "big")] + [(k, "w " * 11, f"small{k:03d}") for k in range(1, 101)]
    got = check(spark, [(*r, "x", 1) for r in rows])
    assert sum(r.taken for r in got) <= 2250
    assert [r.taken for r in got if r.source == "big"] == [0]
