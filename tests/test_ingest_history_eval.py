"""Chunking, margins, sections, store, history and metrics on literal rows."""

import math

import pytest

from quarry.operators.chunking import (fixed_window_chunks, markdown_sections, merge_by_heading,
                                       recursive_chunks, split_recursive)
from quarry.operators.evaluate import macro_average, query_metrics
from quarry.operators.history import reduce_history, summary_input
from quarry.operators.margins import remove_repeated_margins
from quarry.operators.store import delete_document, list_records, upsert


@pytest.mark.parametrize("n,expected", [(0, 0), (1, 1), (999, 1), (1000, 1), (1001, 2), (1800, 2), (1801, 3)])
def test_fixed_windows(spark, n, expected):
    docs = spark.createDataFrame([(1, "x" * n)], "doc_id int, text string")
    rows = fixed_window_chunks(docs).orderBy("partition_number").collect()
    assert len(rows) == expected
    if rows:
        assert rows[-1].start + len(rows[-1].text) - 1 == n      # last window reaches the end
        assert all(len(r.text) <= 1000 for r in rows)


def test_recursive_split_properties():
    text = "\n".join(("sentence %d. " % i) * 30 for i in range(40))
    chunks = split_recursive(text)
    assert all(len(c) <= 1000 for c in chunks)
    assert chunks[0] == text[:len(chunks[0])]
    # consecutive chunks overlap (carry) and together cover every line
    for line in text.split("\n"):
        assert any(line.strip() in c for c in chunks)
    # no separator at all -> per-character packing
    assert split_recursive("a" * 2500) == ["a" * 1000, "a" * 1000, "a" * 900]
    assert split_recursive("") == []


def test_recursive_udf(spark):
    docs = spark.createDataFrame([(1, "ab\n\ncd"), (2, None)], "doc_id int, text string")
    out = recursive_chunks(docs).collect()
    assert [(r.doc_id, r.text) for r in out] == [(1, "ab\n\ncd")]


def test_markdown_sections(spark):
    md = "# A\n## B\ntext1\n# C\ntext2\n\ntext3"
    docs = spark.createDataFrame([(1, md), (2, "plain\nlines")], "doc_id int, text string")
    rows = markdown_sections(docs).orderBy("doc_id", "section_no").collect()
    got = [(r.doc_id, r.content, r.header_1, r.header_2) for r in rows]
    assert got == [(1, "text1", "A", "B"), (1, "text2  \ntext3", "C", None), (2, "plain\nlines", None, None)]
    merged = merge_by_heading(markdown_sections(docs)).orderBy("doc_id", "group_no").collect()
    assert [(r.doc_id, r.heading) for r in merged] == [(1, "A"), (1, "C"), (2, "No_Heading")]


def test_margins(spark):
    rows = []
    for page in range(4):
        rows.append((1, page, 100.0, 0, "HEADER", 99.0, 90.0))          # top band, 4 times
        rows.append((1, page, 100.0, 1, f"body {page}", 60.0, 40.0))
        if page < 2:
            rows.append((1, page, 100.0, 2, "twice", 10.0, 5.0))       # bottom band, twice only
    rows.append((1, 0, 100.0, 3, "edge", 85.0, 80.0))                  # exactly 85 %: not in a band
    blocks = spark.createDataFrame(rows, "doc_id int, page_no int, page_height double, block_no int, "
                                         "text string, top double, bottom double")
    out = {r.page_no: r.text for r in remove_repeated_margins(blocks).collect()}
    assert out == {0: "body 0twiceedge", 1: "body 1twice", 2: "body 2", 3: "body 3"}


def _records(spark, rows):
    return spark.createDataFrame(rows, "id string, embedding array<float>, tags array<string>, "
                                       "content string, payload string")


def test_upsert_semantics(spark):
    base = _records(spark, [("1", None, ["a:1"], "x", "{}"), ("2", None, ["a:2"], "y", "{}")])
    inc = spark.createDataFrame([("2", None, None, "new\u0000", None, 1), ("2", None, ["z"], "last", None, 2),
                                 ("3", None, ["b"], None, None, 1)],
                                "id string, embedding array<float>, tags array<string>, content string, "
                                "payload string, seq int")
    out = {r.id: (r.tags, r.content, r.payload) for r in upsert(base, inc, seq="seq").collect()}
    assert out == {"1": (["a:1"], "x", "{}"), "2": (["z"], "last", "{}"), "3": (["b"], "", "{}")}
    once = upsert(base, inc.drop("seq").where("content = 'last'"))
    twice = upsert(once, inc.drop("seq").where("content = 'last'"))
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))


def test_delete_and_list(spark):
    recs = _records(spark, [(str(i), None, [f"__document_id:doc{i % 2}"], "c", "{}") for i in range(6)])
    assert sorted(r.id for r in delete_document(recs, "doc0").collect()) == ["1", "3", "5"]
    assert [r.id for r in list_records(recs, limit=2, offset=1).collect()] == ["1", "2"]
    assert list_records(recs, limit=0).count() == 6
    assert [r.id for r in list_records(recs, filters=[["__document_id:doc1"]], limit=1).collect()] == ["1"]


def _judged(spark, labels):
    return spark.createDataFrame([(1, i + 1, l) for i, l in enumerate(labels)],
                                 "query_id int, rank int, is_relevant int")


def test_metrics(spark):
    m = query_metrics(_judged(spark, [3, 0, 1, 0, 0])).collect()[0]
    assert m.precision == pytest.approx(0.4) and m.mrr == 1.0
    assert m.ndcg == pytest.approx(3.5 / (3 + 1 / math.log2(3)))
    assert query_metrics(_judged(spark, [1, 3, 0, 0, 0])).collect()[0].mrr == 0.5
    assert query_metrics(_judged(spark, [3, None, 1])).collect()[0].ndcg == 0.0
    short = query_metrics(_judged(spark, [0, 3])).collect()[0]
    assert short.ndcg == pytest.approx((3 / math.log2(3)) / 3)
    assert query_metrics(_judged(spark, [0, 0])).collect()[0].ndcg == 0.0
    macro = macro_average(query_metrics(_judged(spark, [3, 0, 1, 0, 0]))).collect()[0]
    assert macro.mean_mrr == 1.0


def test_reduce_history_fixture(spark):
    # 18 messages: system, alternating user/assistant, one tool result at index 5
    roles = ["system"] + ["user" if i % 2 == 1 else "assistant" for i in range(1, 18)]
    rows = [(1, i, roles[i], f"m{i}", i == 5) for i in range(18)]
    roles[5] = "tool"
    rows[5] = (1, 5, "tool", "m5", True)
    msgs = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string, has_function_item boolean")
    out = reduce_history(msgs, 5).orderBy("out_pos").collect()
    assert [(r.kind, r.turn) for r in out] == [
        ("system", 0), ("summary", None), ("function", 5), ("tail", 14), ("tail", 15), ("tail", 16), ("tail", 17)]
    assert [r.out_pos for r in out] == list(range(7))
    si = sorted(r.turn for r in summary_input(msgs, 5).collect())
    assert si == [t for t in range(14) if t != 5]
    short = reduce_history(msgs.where("turn < 4"), 5).collect()
    assert {r.kind for r in short} == {"kept"}


def test_append_turn_and_clean(spark):
    from quarry.operators.history import append_turn, clean_history, history_tail
    msgs = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "  "), (2, 0, "user", None)],
                                 "conv_id int, turn int, role string, text string")
    assert sorted((r.conv_id, r.turn) for r in clean_history(msgs).collect()) == [(1, 0)]
    turns = spark.createDataFrame([(1, "u2", "a2"), (3, "u", "a")], "conv_id int, user_text string, assistant_text string")
    out = sorted((r.conv_id, r.turn, r.role, r.text) for r in append_turn(msgs, turns).collect()
                 if r.text in ("u2", "a2", "u", "a"))
    assert out == [(1, 2, "user", "u2"), (1, 3, "assistant", "a2"), (3, 0, "user", "u"), (3, 1, "assistant", "a")]
    assert sorted(r.turn for r in history_tail(msgs, 1).collect()) == [0, 1]


def test_format_fact_and_dedup(spark):
    from quarry.functions.text import format_fact
    from quarry.operators.chunking import dedup_by_hash
    df = spark.createDataFrame([("2024-01-01", "s.txt", "body")], "u string, s string, c string")
    assert df.select(format_fact("u", "s", "c")).first()[0] == "=== Last update:2024-01-01 ===\nSource:s.txt\nbody\n"
    rows = spark.createDataFrame([("b", "h1"), ("a", "h1"), ("c", "h2")], "id string, content_sha256 string")
    assert sorted(map(tuple, dedup_by_hash(rows).collect())) == [("h1", "a", 2), ("h2", "c", 1)]


def test_reduce_history_multi_summary(spark):
    # two earlier summaries, then system-less dialogue of 10 messages
    rows = [(1, 0, "assistant", "s0", False, True), (1, 1, "assistant", "s1", False, True)]
    rows += [(1, t, "user" if t % 2 == 0 else "assistant", f"m{t}", False, False) for t in range(2, 12)]
    msgs = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string, "
                                       "has_function_item boolean, is_summary boolean")
    out = reduce_history(msgs, 4, summary_count=2).orderBy("out_pos").collect()
    # n=12, t=4 -> threshold index 8 > insertion 2; cut starts at 8 (a user message)
    assert [(r.kind, r.turn) for r in out] == [("summary_prior", 0), ("summary_prior", 1), ("summary", None),
                                               ("tail", 8), ("tail", 9), ("tail", 10), ("tail", 11)]
    si = sorted(r.turn for r in summary_input(msgs, 4, summary_count=2).collect())
    assert si == list(range(2, 8))


def test_recursive_separators():
    # "\n\n" first: pieces keep the separator at their start, packing carries <= overlap
    assert split_recursive("aaaa\n\nbbbb\n\ncccc", 10, 3) == ["aaaa\n\nbbbb", "cccc"]
    # only "\r": it is found before "\n" and "."
    assert split_recursive("ab\rcd", 10, 3) == ["ab\rcd"]
    assert split_recursive("aaaaaa\rbbbbbb", 10, 3) == ["aaaaaa", "bbbbbb"]
    # a sentence longer than the size falls through "." to single characters
    # (2 characters of overlap carried); the recursion's chunks are not merged
    # with the pieces that follow
    assert split_recursive("x" * 12 + ". yy", 10, 2) == ["x" * 10, "xxxx", ". yy"]


def test_context_block_literal(spark):
    from quarry.operators.context import citations, context_blocks
    res = spark.createDataFrame(
        [(1, "s1", 0.9, " first \r\nline\n\n\nsecond "), (1, "s1", 0.5, "  \n "), (1, "s2", 0.7, "other")],
        "query_id int, source string, score double, content string")
    qs = spark.createDataFrame([(1, "Quoi ?"), (2, "Rien ?"), (3, "   ")], "query_id int, query_text string")
    out = {r.query_id: r.context for r in
           context_blocks(citations(res, source="source"), qs, instructions="INSTR").collect()}
    assert out[1] == ("INSTR\n[QUESTION]\nQuoi ?\n\n[SEARCH RESULTS]\n"
                      "Source: s1\n—— first line\nsecond\n\n"
                      "Source: s2\n—— other\n\n")
    assert out[2] == "INSTR\n[QUESTION]\nRien ?\n\nAucun result trouvé.\n"
    assert 3 not in out


def test_refined_terms_literal(spark):
    import math
    from quarry.operators.refine import refined_terms
    corpus = spark.createDataFrame([(1, "chat chien"), (2, "chat oiseau"), (3, "chat")], "doc_id int, text string")
    qs = spark.createDataFrame([(7, "Le chat et le poisson, le chien")], "query_id int, query_text string")
    out = [(r.term, round(r.idf, 9)) for r in refined_terms(qs, corpus, k=2).orderBy("term_rank").collect()]
    # poisson: df 0 -> ln(4/1); chien: df 1 -> ln(4/2); chat: df 3 -> ln(4/4); stop words dropped
    assert out == [("poisson", round(math.log(4.0), 9)), ("chien", round(math.log(2.0), 9))]


def test_routing_and_skip(spark):
    from quarry.operators.routing import route_files, skip_imported
    files = spark.createDataFrame([("/d/a.PDF",), ("/d/b.md",), ("/d/c.html",), ("/d/d",)], "path string")
    r = {x.name: (x.mime_type, x.supported, x.loader) for x in route_files(files).collect()}
    assert r["a.PDF"] == ("application/pdf", True, "pdf")
    assert r["b.md"] == ("text/markdown", True, "markdown")
    assert r["c.html"] == ("text/html", False, None)
    assert r["d"] == (None, False, None)
    docs = spark.createDataFrame([("x", 1), ("y", 2)], "document_id string, n int")
    ready = spark.createDataFrame([("y",)], "document_id string")
    assert [x.document_id for x in skip_imported(docs, ready).collect()] == ["x"]


def test_blocks_from_lines(spark):
    from quarry.operators.margins import blocks_from_lines
    docs = spark.createDataFrame([(1, "\n".join(f"l{i}" for i in range(12)))], "doc_id int, text string")
    b = {(x.page_no, x.block_no): (x.top, x.bottom) for x in blocks_from_lines(docs).collect()}
    assert b[(0, 0)] == (100.0, 90.0) and b[(0, 9)] == (10.0, 0.0) and b[(1, 1)] == (90.0, 80.0)
    assert len(b) == 12
