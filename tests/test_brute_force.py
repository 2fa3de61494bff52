"""Spark operators against direct Python implementations on random and
skewed fixtures (one key holding a third of all rows)."""

import random

import pytest

from quarry.operators.history import reduce_history
from quarry.operators.text_search import text_search


def _cover_rank(doc_tokens, query_terms):
    """Sequential minimal-cover scan: from the current start find the first
    end where every term was seen, walk back to the latest start, score
    0.1 / (1 + noise), restart after the cover's first hit."""
    hits = [(p, t) for p, t in enumerate(doc_tokens) if t in query_terms]
    n = len(query_terms)
    score, start = 0.0, 0
    while True:
        seen, end = set(), None
        for i in range(start, len(hits)):
            seen.add(hits[i][1])
            if len(seen) == n:
                end = i
                break
        if end is None:
            return score
        seen, begin = set(), None
        for i in range(end, start - 1, -1):
            seen.add(hits[i][1])
            if len(seen) == n:
                begin = i
                break
        noise = (hits[end][0] - hits[begin][0]) - (end - begin)
        score += 0.1 / (1 + noise)
        start = begin + 1


def test_cover_density_random(spark):
    rnd = random.Random(11)
    vocab = ["w%d" % i for i in range(6)]
    docs = [(str(i), " ".join(rnd.choice(vocab) for _ in range(rnd.randint(1, 40)))) for i in range(60)]
    # "w0" is in most records: a hot lexeme
    docs += [(str(100 + i), "w0 " * rnd.randint(1, 5)) for i in range(30)]
    queries = [(j, " ".join(rnd.sample(vocab, rnd.randint(1, 3)))) for j in range(25)]
    recs = spark.createDataFrame(docs, "id string, content string")
    qs = spark.createDataFrame(queries, "query_id int, query_text string")
    got = {(r.query_id, r.id): r.text_score for r in text_search(recs, qs).collect()}
    want = {}
    for qid, qtext in queries:
        terms = set(qtext.split())
        for did, text in docs:
            toks = text.split()
            if terms <= set(toks):
                want[(qid, did)] = _cover_rank(toks, terms)
    assert got.keys() == want.keys()
    for key, val in want.items():
        assert got[key] == pytest.approx(val)


def _reduce(msgs, target, threshold=0):
    """Direct reduction of one conversation (list of (role, is_function))."""
    n = len(msgs)
    has_sys = any(r == "system" for r, _ in msgs)
    t = target - (1 if has_sys else 0)
    thr = n - threshold - t
    if thr <= 0:
        return None
    i = min(n - t, n - 1)
    while i >= 0 and msgs[i][1]:
        i -= 1
    cut = i
    while i >= thr:
        if msgs[i][0] == "user" and not msgs[i][1]:
            return i
        i -= 1
    return cut


def test_reduce_history_random_and_hot(spark):
    rnd = random.Random(5)
    rows, convs = [], {}
    for c in range(40):
        length = 200 if c == 0 else rnd.randint(1, 12)      # conversation 0 holds a third of the rows
        msgs = []
        for turn in range(length):
            role = "system" if turn == 0 and rnd.random() < 0.5 else rnd.choice(["user", "assistant", "tool"])
            msgs.append((role, role == "tool"))
            rows.append((c, turn, role, f"m{turn}", role == "tool"))
        convs[c] = msgs
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string, has_function_item boolean")
    for target, threshold in [(5, 0), (4, 2)]:
        out = reduce_history(df, target, threshold).collect()
        by = {}
        for r in out:
            by.setdefault(r.conv_id, []).append(r)
        for c, msgs in convs.items():
            cut = _reduce(msgs, target, threshold)
            got = sorted(by[c], key=lambda r: r.out_pos)
            if cut is None or cut < 0:
                assert [r.kind for r in got] == ["kept"] * len(msgs)
                continue
            first_sys = next((i for i, (r, _) in enumerate(msgs) if r == "system"), None)
            want = ([("system", first_sys)] if first_sys is not None else []) + [("summary", None)]
            want += [("function", i) for i in range(cut) if msgs[i][1] and i != first_sys]
            want += [("tail", i) for i in range(cut, len(msgs)) if i != first_sys]
            assert [(r.kind, r.turn) for r in got] == want


def test_text_search_distributed_path_matches(spark):
    from quarry.operators.text_search import LexemeIndex, text_matches
    from quarry.sources.tables import query_set, records
    sf = "/root/testdata/sf0.001"
    r, q = records(spark, sf), query_set(spark, sf)
    a = {(x.query_id, x.id, round(x.text_score, 9)) for x in text_search(r, q, length_norm=True).collect()}
    b = {(x.query_id, x.id, round(x.text_score, 9))
         for x in text_search(r, q, length_norm=True, max_query_lexemes=10).collect()}
    assert a == b and a
    idx = LexemeIndex.build(r)
    m1 = {tuple(x) for x in text_matches(idx, q).collect()}
    m2 = {tuple(x) for x in text_matches(idx, q, max_query_lexemes=10).collect()}
    assert m1 == m2
