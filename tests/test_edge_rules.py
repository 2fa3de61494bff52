"""Literal cases of rules that the driver tables do not exercise."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.functions.text import normalize_index_name
from quarry.functions.vectors import cosine_distance
from quarry.operators.chunking import markdown_sections
from quarry.operators.context import citations, context_blocks
from quarry.operators.evaluate import macro_average, query_metrics
from quarry.operators.fusion import hybrid_candidates, hybrid_search
from quarry.operators.history import clean_history, history_tail, reduce_history, summary_input
from quarry.operators.routing import route_files
from quarry.operators.store import delete_documents, list_records
from quarry.operators.text_search import LexemeIndex, text_search
from quarry.operators.vector_search import vector_candidates, vector_search
from quarry.sources.catalog import IndexCatalog, normalize_name
from quarry.sources.files import read_chunks, read_history, write_chunks, write_history
from quarry.sources.tables import records, records_from
from quarry.streaming.ingest import compact, read_merged, start_ingest

RECORD = "id string, embedding array<float>, tags array<string>, content string, payload string"


def _records(spark, rows):
    return spark.createDataFrame([(i, v, t, c, "{}") for i, v, t, c in rows], RECORD)


def _messages(spark, n, blank=(), system=(), function=()):
    rows = [(1, k, "system" if k in system else "user" if k % 2 == 0 else "assistant",
             " " if k in blank else f"m{k}", k in function) for k in range(n)]
    return spark.createDataFrame(rows, "conv_id int, turn int, role string, text string, has_function_item boolean")


# -- records -------------------------------------------------------------------------

def test_records_without_a_vector_stay(spark):
    docs = spark.createDataFrame([(1, "alpha", "en", "s", 5), (2, "beta", "fr", "s", 4)],
                                 "doc_id int, text string, lang string, source string, n_chars int")
    emb = spark.createDataFrame([(1, [1.0, 0.0])], "vec_id int, embedding array<float>")
    recs = records_from(docs, emb)
    assert {(r.id, r.embedding is None) for r in recs.collect()} == {("1", False), ("2", True)}
    qs = spark.createDataFrame([(9, "beta", [1.0, 0.0])], "query_id int, query_text string, query_vec array<float>")
    assert [r.id for r in text_search(recs, qs, 5).collect()] == ["2"]
    assert [r.id for r in vector_search(recs, qs, 5).collect()] == ["1"]


def test_whole_corpus_is_read(spark):
    sf = "/root/testdata/sf0.001"
    assert records(spark, sf).count() == spark.read.parquet(f"{sf}/documents.parquet").count()


# -- vectors -------------------------------------------------------------------------

def test_limit_zero_searches_nothing(spark):
    recs = _records(spark, [("a", [1.0, 0.0], [], "alpha")])
    qs = spark.createDataFrame([(1, "alpha", [1.0, 0.0])], "query_id int, query_text string, query_vec array<float>")
    vec, txt, n = hybrid_candidates(recs, qs, 0, "rrf")
    assert vec.count() == 0 and txt.count() == 0 and n == 0
    assert hybrid_search(recs, qs, 0).count() == 0


@pytest.mark.parametrize("block", [100, 2])
def test_dimensions_zero_vectors_and_empty_batches(spark, block):
    recs = _records(spark, [("a", [1.0, 0.0], [], ""), ("z", [0.0, 0.0], [], ""), ("n", None, [], ""),
                            ("o", [1.0, 0.0, 0.0], [], "")])
    schema = "query_id int, query_vec array<float>"
    qs = spark.createDataFrame([(k, [1.0, 0.1 * k]) for k in range(5)] + [(8, [0.0, 0.0]), (9, None)], schema)
    got = {(r.query_id, r.id) for r in vector_candidates(recs, qs, 3, max_broadcast_queries=block).collect()}
    assert got == {(k, "a") for k in range(5)}
    none = spark.createDataFrame([], schema)
    assert vector_candidates(recs, none, 3, max_broadcast_queries=block).collect() == []
    mixed = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0]), (3, [1.0])], schema)
    with pytest.raises(ValueError):
        vector_candidates(recs, mixed, 3, max_broadcast_queries=block)


def test_equal_vectors_are_cut_by_id(spark):
    recs = _records(spark, [(f"r{k:04d}", [1.0, 2.0], [], "") for k in range(500)])
    qs = spark.createDataFrame([(q, [1.0, 1.0]) for q in range(3)], "query_id int, query_vec array<float>")
    got = vector_candidates(recs.coalesce(1), qs, 5)
    assert {(r.query_id, r.id) for r in got.collect()} == {(q, f"r{k:04d}") for q in range(3) for k in range(5)}
    from quarry.operators import vector_search as vs
    batch = list(vs._score_batch(vs._unit_rows(np.ones((500, 2))), np.array([f"{k:03d}" for k in range(500)]),
                                 vs._unit_rows(np.ones((3, 2))), 5, None))
    assert sum(len(b[0]) for b in batch) == 15


def test_large_batches_do_not_shuffle_records(spark):
    recs = _records(spark, [(f"r{k}", [1.0, float(k)], [], "") for k in range(40)])
    qs = spark.createDataFrame([(q, [1.0, float(q)]) for q in range(9)], "query_id int, query_vec array<float>")
    plan = vector_candidates(recs, qs, 2, max_broadcast_queries=4)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("MapInArrow"):]
    assert "Exchange" not in below


def test_cosine_of_a_zero_vector_is_null(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    assert df.select(cosine_distance("a", "b")).first()[0] is None


# -- text ----------------------------------------------------------------------------

def test_filters_hold_with_a_saved_index(spark, tmp_path):
    recs = _records(spark, [(str(k), [1.0, float(k)], [f"lang:{'fr' if k % 2 else 'en'}"], "alpha beta") for k in range(6)])
    qs = spark.createDataFrame([(1, "alpha", [1.0, 0.0])], "query_id int, query_text string, query_vec array<float>")
    index = LexemeIndex.build(recs).save(str(tmp_path / "idx"), n_files=2)
    for i in (None, index):
        got = {r.id for r in hybrid_search(recs, qs, 6, "max_norm", filters=[["lang:fr"]], index=i).collect()}
        assert got == {"1", "3", "5"}


def test_a_hot_lexeme_is_spread_over_files(spark, tmp_path):
    recs = spark.range(4000).selectExpr("cast(id AS string) AS id", "'common' AS content")
    index = LexemeIndex.build(recs).save(str(tmp_path / "idx"), n_files=8)
    files = index.terms.groupBy(F.input_file_name()).count().collect()
    assert len(files) > 3 and max(r["count"] for r in files) < 2000


# -- history -------------------------------------------------------------------------

def test_positions_do_not_count_gaps(spark):
    cleaned = clean_history(_messages(spark, 9, blank=(5, 6, 7)))
    assert sorted(r.turn for r in history_tail(cleaned, 4).collect()) == [2, 3, 4, 8]
    for blank in ((0, 1, 2), (1, 2, 3)):
        gaps = clean_history(_messages(spark, 9, blank=blank))
        order = {r.turn: k for k, r in enumerate(sorted(gaps.collect(), key=lambda r: r.turn))}
        dense = spark.createDataFrame([(1, order[r.turn], r.role, r.text, r.has_function_item) for r in gaps.collect()],
                                      gaps.schema)
        a = [(r.kind, r.text) for r in reduce_history(gaps, 3).orderBy("out_pos").collect()]
        b = [(r.kind, r.text) for r in reduce_history(dense, 3).orderBy("out_pos").collect()]
        assert a == b and ("summary", None) in a
        assert sorted(r.text for r in summary_input(gaps, 3).collect()) == sorted(
            r.text for r in summary_input(dense, 3).collect())


def test_history_round_trip(spark, tmp_path):
    m = _messages(spark, 5, function=(3,)).unionByName(_messages(spark, 4).withColumn("conv_id", F.lit(7)))
    write_history(m, str(tmp_path / "h"))
    back = read_history(spark, str(tmp_path / "h"))
    key = lambda r: (r.conv_id, r.turn)
    got = [(int(r.conv_id), r.turn, r.role, r.text, r.has_function_item) for r in sorted(back.collect(), key=key)]
    assert got == sorted((r.conv_id, r.turn, r.role, r.text, r.has_function_item) for r in m.collect())


# -- files, names, sections ----------------------------------------------------------

def test_hash_and_question_mark_in_paths(spark):
    df = spark.createDataFrame([("/x/C# notes.txt",), ("/C#/n.md",), ("/a/what?.pdf",)], "path string")
    got = {r.path: (r.name, r.loader is not None) for r in route_files(df).collect()}
    assert got == {"/x/C# notes.txt": ("C# notes.txt", True), "/C#/n.md": ("n.md", True), "/a/what?.pdf": ("what?.pdf", True)}


def test_index_names_agree(spark):
    names = ["\tA b\t", "x.y_z", "  q ", "\t", "a b"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r[0] for r in df.select(normalize_index_name("n")).collect()]
    assert got == [normalize_name(n, blank_ok=True) or None for n in names]


def test_code_fences_hide_headings(spark):
    text = "# T\nbefore\n```py\n# comment\n\n## no heading\n```\nafter\n~~~\n```\n# x\n~~~\n## S\nend"
    rows = markdown_sections(spark.createDataFrame([(1, text)], "doc_id int, text string")).orderBy("section_no").collect()
    assert [(r.header_1, r.header_2) for r in rows] == [("T", None), ("T", "S")]
    assert "# comment" in rows[0].content and "## no heading" in rows[0].content and "# x" in rows[0].content
    assert rows[1].content == "end"


def test_chunk_store_keeps_other_parents(spark, tmp_path):
    path = str(tmp_path / "chunks")
    rows = lambda p, n: spark.createDataFrame([(f"{p}{k}", p, k) for k in range(n)], "id string, parent_id string, k int")
    write_chunks(rows("a", 3), path)
    write_chunks(rows("b", 2), path)
    write_chunks(rows("a", 1), path)
    assert sorted(r.id for r in read_chunks(spark, path).collect()) == ["a0", "b0", "b1"]


def test_shorter_reimport_leaves_no_stale_chunk(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    put = lambda rows, n: spark.createDataFrame(rows, "doc_id int, text string").coalesce(1).write.parquet(f"{src}/f{n}")

    def ingest():
        start_ingest(spark, f"{src}/*", out, str(tmp_path / "cp"), file_pattern="*.parquet").awaitTermination()

    put([(1, "x" * 3000), (2, "y" * 1500)], 0)
    ingest()
    assert read_merged(spark, out).count() == 6
    put([(1, "x" * 500), (2, "")], 1)
    ingest()
    assert [(r.parent_id, r.partition_number) for r in read_merged(spark, out).collect()] == [("1", 0)]
    compact(spark, out, str(tmp_path / "new"))
    assert read_merged(spark, str(tmp_path / "new")).count() == 1


# -- store ---------------------------------------------------------------------------

def test_records_without_the_document_tag(spark):
    recs = _records(spark, [("a", None, ["__document_id:d1"], "x"), ("b", None, [], "y"), ("c", None, None, "z")])
    docs = spark.createDataFrame([("d1",)], "document_id string")
    assert sorted(r.id for r in delete_documents(recs, docs).collect()) == ["b", "c"]
    hits = recs.select(F.lit(1).alias("query_id"), "*", F.lit(0.5).alias("score"))
    cits = citations(hits)
    blocks = context_blocks(cits, spark.createDataFrame([(1, "q?")], "query_id int, query_text string")).collect()
    assert "—— y" in blocks[0].context and "—— x" in blocks[0].context


def test_offset_without_limit_stays_distributed(spark):
    recs = _records(spark, [(f"{k:03d}", None, [], str(k)) for k in range(50)])
    page = list_records(recs, limit=0, offset=7)
    assert [r.id for r in page.collect()] == [f"{k:03d}" for k in range(7, 50)]
    assert "CollectLimit" not in page._jdf.queryExecution().executedPlan().toString()
    assert list_records(recs, limit=0, offset=99).collect() == []


def test_vector_size_of_an_index(spark, tmp_path):
    cat = IndexCatalog(spark, prefix="vs", root=str(tmp_path / "idx"), buckets=2)
    cat.drop_all()
    cat.create("one", vector_size=2)
    cat.upsert("one", _records(spark, [("a", [1.0, 2.0], [], "x"), ("b", None, [], "y")]))
    cat.upsert("one", _records(spark, [("a", [2.0, 2.0], [], "z")]))
    assert {(r.id, r.content) for r in cat.read("one").collect()} == {("a", "z"), ("b", "y")}
    with pytest.raises(Exception, match="2 values"):
        cat.upsert("one", _records(spark, [("c", [1.0, 2.0, 3.0], [], "x")]))
    assert cat.read("one").count() == 2
    cat.drop_all()


# -- evaluation ----------------------------------------------------------------------

def test_macro_average_over_all_queries(spark):
    judged = spark.createDataFrame([(1, 1, 3), (1, 2, 0)], "query_id int, rank int, is_relevant int")
    asked = spark.createDataFrame([(1,), (2,)], "query_id int")
    m = query_metrics(judged)
    assert macro_average(m, asked).first().asDict() == {
        "n_queries": 2, "mean_precision": 0.25, "mean_mrr": 0.5, "mean_ndcg": 0.5}


def test_unbroken_text_is_cut_by_arithmetic():
    from quarry.operators.chunking import _pack, split_recursive
    for n in (0, 1, 9, 10, 11, 16, 17, 22, 23, 100):
        for size, overlap in ((10, 3), (10, 0), (7, 6), (2, 1)):
            text = "".join(chr(97 + k % 26) if k % 5 else "\t" for k in range(n))
            assert split_recursive(text, size, overlap) == (_pack(list(text), size, overlap) if text else [])


def test_french_stem(spark):
    from quarry.functions.text import french_stem
    pairs = [("dossiers", "dossier"), ("chevaux", "cheval"), ("nationale", "national"), ("continuelles", "continuel"),
             ("chat", "chat")]
    df = spark.createDataFrame(pairs, "a string, b string")
    assert all(r[0] == r[1] for r in df.select(french_stem("a"), french_stem("b")).collect())
    recs = spark.createDataFrame([("1", "les dossiers nationaux"), ("2", "autre")], "id string, content string")
    qs = spark.createDataFrame([(1, "dossier national")], "query_id int, query_text string")
    assert [r.id for r in text_search(recs, qs, 5, stemmer=french_stem).collect()] == ["1"]
    assert text_search(recs, qs, 5).collect() == []


def test_files_become_searchable_records(spark, tmp_path):
    from quarry.operators.loading import import_files
    from quarry.operators.store import delete_documents
    cat = IndexCatalog(spark, prefix="imp", root=str(tmp_path / "idx"), buckets=2)
    cat.drop_all()
    path = lambda n: f"/in/{n}"
    files = lambda rows: spark.createDataFrame([(path(n), bytearray(t.encode())) for n, t in rows], "path string, content binary")
    import_files(cat, "files", files([("a#1.txt", "alpha beta"), ("b.md", "# T\ngamma delta\n# U\nmore"), ("c.pdf", "%PDF")]))
    recs = cat.read("files")
    assert {r.tags[0] for r in recs.collect()} == {"__document_id:/in/a#1.txt", "__document_id:/in/b.md"}
    qs = spark.createDataFrame([(1, "gamma")], "query_id int, query_text string")
    assert text_search(recs, qs, 3).count() == 1
    import_files(cat, "files", files([("b.md", "plain now")]))
    assert sorted(r.content for r in cat.read("files").collect()) == ["alpha beta", "plain now"]
    gone = spark.createDataFrame([(path("a#1.txt"),)], "document_id string")
    assert [r.content for r in delete_documents(cat.read("files"), gone).collect()] == ["plain now"]
    cat.drop_all()
