"""Benchmark decontamination against a brute-force window search."""

import random
import re
from collections import Counter

import pyarrow.parquet as pq

from quarry.llm import decontaminate as D

SF = "/root/testdata/sf0.001"


def terms(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def brute(docs, items, similarity=0.8):
    out = {}
    for item, body in items:
        w = terms(body)
        if not w:
            continue
        n = min(5, len(w))
        a = Counter(tuple(w[i:i + n]) for i in range(len(w) - n + 1))
        m = sum(a.values())
        for doc, text in docs:
            x = terms(text)
            s = [tuple(x[i:i + n]) for i in range(len(x) - n + 1)]
            if not any(k in a for k in s):
                continue
            for start in range(max(1, len(s) - m + 1)):
                b = Counter(s[start:start + m])
                both = sum((a & b).values())
                sim = both / (m + sum(b.values()) - both)
                if sim >= similarity and sim > out.get((doc, item), (0,))[0]:
                    out[doc, item] = (sim, start)
    return out


def check(spark, docs, items):
    d = spark.createDataFrame([(*x, "c") for x in docs], "doc_id long, text string, item_id string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.similarity, r.start) for r in D.leaks(d, b).collect()}
    joined = {(r.doc_id, r.item_id): (r.similarity, r.start) for r in D.leaks(d, b, inline=0).collect()}
    assert joined == got
    want = brute(docs, items)
    assert set(got) == set(want)
    for k, (sim, _) in want.items():
        assert abs(got[k][0] - sim) < 1e-6
    return got


def test_whole_table(spark):
    d = pq.read_table(f"{SF}/documents.parquet").to_pydict()
    b = pq.read_table(f"{SF}/benchmark.parquet").to_pydict()
    got = check(spark, list(zip(d["doc_id"], d["text"])), list(zip(b["item_id"], b["text"])))
    assert got


def test_edits_places_and_edges(spark):
    rnd = random.Random(5)
    word = lambda: "w%d" % rnd.randrange(5000)
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([60, 40, 25, 9, 5, 3, 1, 80])]
    items += [(0, " ".join(word() for _ in range(30))), (None, items[1][1])]  # an id used twice, and none
    items += [(90, ""), (91, None), (92, "a a a a a a a a a a a a"), (93, items[0][1])]
    docs, k = [(1, None), (2, ""), (3, "a " * 500), (4, "a a a a a a a a a a")], 10
    for _, body in items[:8]:
        w = body.split()
        for edit in range(7):
            x = list(w)
            if edit == 1:
                x[len(x) // 2] = "changed"
            elif edit == 2:
                x[-1] = "changed"
            elif edit == 3 and len(x) > 20:
                x.insert(10, "added")
            elif edit == 4:
                x = x[:-1] or x
            elif edit == 5:
                x = [y.upper() + "," for y in x]
            elif edit == 6 and len(x) > 20:
                x.insert(3, "one")
                x.insert(-3, "two")
            before = [word() for _ in range(rnd.choice([0, 3, 400]))]
            after = [word() for _ in range(rnd.choice([0, 4, 300]))]
            docs.append((k, " ".join(before + x + after)))
            k += 1
    docs += [(7, docs[-1][1]), (7, docs[-1][1])]
    got = check(spark, docs, items)
    assert len(got) > 40


def test_clean_rows_stay(spark):
    item = " ".join(f"i{k}" for k in range(30))
    docs = spark.createDataFrame([(1, "before " + item, "x"), (2, "clean text", "y"), (None, None, "z"), (2, "clean text", "y")],
                                 "doc_id long, text string, h string")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = D.decontaminated(docs, items)
    assert got.columns == docs.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, docs.where("doc_id is null or doc_id = 2").collect()))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    assert D.leaks(none, items).collect() == []
    docs = spark.createDataFrame([(1, "one two three four five six")], "doc_id long, text string")
    assert D.leaks(docs, items.limit(0)).collect() == []
    assert D.decontaminated(docs, items.limit(0)).count() == 1
