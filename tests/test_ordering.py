"""Global row numbers, rank selection, deep pages, key expressions, headings across documents."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import ordering as O
from quarry.operators.chunking import merge_by_heading_across
from quarry.operators.history import append_turn
from quarry.operators.refine import key_expressions
from quarry.operators.routing import document_ordinals
from quarry.operators.store import list_records
from quarry.sources.files import read_chunks, write_chunks


def test_row_numbers(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, "a", "b", "c"]), k) for k in range(500)]
    df = spark.createDataFrame(rows, "k string, id long").repartition(7)
    got = O.row_numbers(df, ["k", "id"], "n", start=3)
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    assert [(r.k, r.id) for r in sorted(got.collect(), key=lambda r: r.n)] == want
    assert sorted(r.n for r in got.collect()) == list(range(3, 503))
    assert O.row_numbers(df.limit(0), ["k"], "n").collect() == []
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan.split("BroadcastExchange")[0]  # only the range counts meet in one task


def test_ordinals_of_files(spark):
    files = spark.createDataFrame([(p,) for p in ["/b", "/a/z", "/a/é", "/a", "/a", None]], "path string")
    got = {(r.path, r.document_id) for r in document_ordinals(files).collect()}
    assert got == {(None, "doc0"), ("/a", "doc1"), ("/a", "doc2"), ("/a/z", "doc3"), ("/a/é", "doc4"), ("/b", "doc5")}


def test_key_at_rank(spark, monkeypatch):
    monkeypatch.setattr(O, "SMALL", 5)
    monkeypatch.setattr(O, "SAMPLE", 40)
    monkeypatch.setattr(O, "RANGES", 4)
    rng = random.Random(2)
    # one key holds a third of the rows, NULL keys come first
    rows = [(None if k % 17 == 0 else 7 if k % 3 == 0 else rng.randint(0, 90), f"r{k:03d}") for k in range(300)]
    df = spark.createDataFrame(rows, "k int, id string").repartition(3)
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    for rank in (0, 1, 17, 18, 100, 151, 298, 299):
        assert tuple(O.key_at_rank(df, ["k", "id"], rank)) == want[rank]
    assert O.key_at_rank(df, ["k", "id"], 300) is None
    assert O.key_at_rank(df.limit(0), ["k", "id"], 0) is None
    with pytest.raises(ValueError):
        O.key_at_rank(df, ["k"], -1)


@pytest.mark.parametrize("limit,offset", [(5, 0), (5, 150), (0, 190), (120, 40), (50, 195), (5, 500), (500, 0)])
def test_pages(spark, limit, offset):
    rows = [(f"id{k:03d}", None, [], str(k % 9), "{}") for k in range(200)]
    recs = spark.createDataFrame(rows, "id string, embedding array<float>, tags array<string>, content string, payload string")
    for order, key in (("id", lambda r: r[0]), ("content", lambda r: (r[3], r[0]))):
        want = [r[0] for r in sorted(rows, key=key)][offset:offset + limit if limit > 0 else None]
        page = list_records(recs, limit=limit, offset=offset, order_by=order, near=20)
        assert [r.id for r in page.collect()] == want and "__key" not in page.columns


def test_key_expressions(spark):
    corpus = spark.createDataFrame([(1, "le chat noir dort. le chat noir mange"), (2, "un chat gris, un mur noir"),
                                    (3, "la NATO et la défense"), (4, "Le mur de Berlin"), (5, None)], "doc_id int, text string")
    ask = spark.createDataFrame([(1, "Que mange le chat noir de Marie Curie à Berlin ?"), (2, "Le rôle de la NATO : défense, mur"),
                                 (3, "le la de"), (4, None), (5, "mur noir")], "query_id int, query_text string")
    got = {}
    for r in key_expressions(ask, corpus, k=9).orderBy("query_id", "term_rank").collect():
        got.setdefault(r.query_id, []).append(r.term)
    assert got[1][0] == "Marie Curie" and "chat noir" in got[1] and "Berlin" in got[1]
    assert "Marie" not in got[1] and "Curie" not in got[1]  # parts of the name
    assert "chat" in got[1] and "mange chat" not in got[1]
    assert "NATO" in got[2] and "défense mur" not in got[2]  # written as in the question; punctuation parts
    assert 3 not in got and 4 not in got
    assert sorted(got[5]) == ["mur", "noir"]  # once together in the corpus is no expression
    assert key_expressions(ask, corpus.limit(0), k=1).count() == 3


def test_headings_across_documents(spark):
    rng = random.Random(5)
    rows = [(d, s, "x" * rng.randint(0, 30), rng.choice(["Intro", "Intro", "Intro", None, "End"]), None, None)
            for d in range(40) for s in range(rng.randint(0, 6))]
    df = spark.createDataFrame(rows, "doc_id int, section_no long, content string, header_1 string, header_2 string, header_3 string")
    texts, first = {}, {}
    for d, s, content, h, _, _ in rows:
        texts.setdefault(h or "No_Heading", []).append(content)
        first.setdefault(h or "No_Heading", len(first))
    for size in (1, 50, 10_000):
        got = merge_by_heading_across(df.repartition(5), part_chars=size).collect()
        for h, parts in texts.items():
            mine = sorted((r.part, r.content, r.heading_no) for r in got if r.heading == h)
            assert "\n".join(c for _, c, _ in mine) == "\n".join(parts)
            assert [p for p, _, _ in mine] == list(range(len(mine))) and {n for _, _, n in mine} == {first[h]}
            assert all(len(c) <= size + 31 for _, c, _ in mine)
    assert merge_by_heading_across(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        merge_by_heading_across(df, part_chars=0)


def test_several_exchanges_of_one_conversation(spark):
    messages = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "ho")], "conv_id int, turn int, role string, text string")
    turns = spark.createDataFrame([(1, "late", "b", 2), (1, "early", "a", 1), (2, "new", "c", 1)],
                                  "conv_id int, user_text string, assistant_text string, at int")
    got = sorted((r.conv_id, r.turn, r.text) for r in append_turn(messages, turns, order="at").collect())
    assert got == [(1, 0, "hi"), (1, 1, "ho"), (1, 2, "early"), (1, 3, "a"), (1, 4, "late"), (1, 5, "b"), (2, 0, "new"), (2, 1, "c")]
    unordered = append_turn(messages, turns.drop("at"))
    assert sorted(r.turn for r in unordered.where("conv_id = 1").collect()) == [0, 1, 2, 3, 4, 5]


def test_emptied_parents_lose_their_chunks(spark, tmp_path):
    path = str(tmp_path / "chunks")
    rows = lambda p, n: spark.createDataFrame([(f"{p}{k}", p, k) for k in range(n)], "id string, parent_id string, k int")
    parents = lambda *p: spark.createDataFrame([(x,) for x in p], "parent_id string")
    write_chunks(rows("a", 2).unionByName(rows("b", 1)), path, parents("a", "b"))
    write_chunks(rows("a", 0), path, parents("a", "c"))
    assert [r.id for r in read_chunks(spark, path).collect()] == ["b0"]
    write_chunks(rows("a", 1), path)
    assert sorted(r.id for r in read_chunks(spark, path).collect()) == ["a0", "b0"]


def test_questions_without_a_vector_are_searched_by_text(spark, tmp_path):
    from quarry.operators.vector_search import vector_candidates
    from quarry.sources.tables import query_set
    spark.createDataFrame([(1, "with"), (2, "without")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, [1.0, 0.0], 0)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    qs = query_set(spark, str(tmp_path))
    assert sorted(r.query_text for r in qs.collect()) == ["with", "without"]
    recs = spark.createDataFrame([("a", [1.0, 0.5])], "id string, embedding array<float>")
    assert [r.query_id for r in vector_candidates(recs, qs, 3).collect()] == [1]
    assert qs.where(F.col("query_vec").isNull()).count() == 1


def test_function_items(spark, tmp_path):
    import json

    from quarry.operators.history import has_function_item, with_defaults
    from quarry.sources.files import read_history
    rows = [(1, [("TextContent", "a"), ("FunctionCallContent", "f")]), (2, [("FunctionResultContent", None)]), (3, [("TextContent", "b"), (None, "c")]),
            (4, []), (5, None)]
    df = spark.createDataFrame(rows, "turn int, items array<struct<kind:string,text:string>>")
    assert [r[0] for r in df.orderBy("turn").select(has_function_item("items")).collect()] == [True, True, False, False, False]
    assert [r.has_function_item for r in with_defaults(df).orderBy("turn").collect()] == [True, True, False, False, False]
    messages = [{"role": "assistant", "content": "x", "items": [{"kind": "FunctionCallContent", "text": "f"}]},
                {"role": "user", "content": "y", "items": [{"kind": "TextContent"}]}, {"role": "user", "content": "z", "has_function_item": True}]
    (tmp_path / "h.json").write_text(json.dumps(messages))
    got = read_history(spark, str(tmp_path / "h.json")).orderBy("turn").collect()
    assert [r.has_function_item for r in got] == [True, False, True]


def test_page_keys_move_no_text(spark, tmp_path):
    """A column of the documents is computed before the join; pages by it equal those by the text."""
    from quarry.sources.tables import records

    rows = [(k, "x" * (k * 37 % 60) if k % 9 else None, "en", f"src{k % 3}", k) for k in range(300)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, [1.0, 2.0]) for k in range(0, 300, 2)], "vec_id long, embedding array<float>").write.parquet(
        str(tmp_path / "embeddings.parquet"))
    r = records(spark, str(tmp_path), content_len=F.length("text"))
    plan = r.select("id", "content_len")._jdf.queryExecution().optimizedPlan().toString()
    assert "length(text" in plan[plan.index("Join"):] and "text" not in plan[:plan.index("length(text")]
    order = sorted(range(300), key=lambda k: (rows[k][1] is not None, len(rows[k][1] or ""), str(k)))
    for limit, offset in ((25, 150), (5, 280), (60, 30), (0, 200), (30, 400)):
        want = [str(k) for k in order[offset:offset + limit if limit else None]]
        for by in ("content_len", F.length("content")):
            page = list_records(r, limit=limit, offset=offset, order_by=by, near=20)
            assert [x.id for x in page.collect()] == want and "content_len" not in page.columns
