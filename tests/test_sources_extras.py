"""Sources, sinks, catalog, approximate search, embedder and token packing."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quarry.functions.text import payload_field
from quarry.operators.chunking import markdown_sections, token_pack
from quarry.operators.fusion import search
from quarry.operators.quantised_search import approx_vector_search
from quarry.operators.vector_search import hashing_embedder, vector_candidates
from quarry.plans.retrieval import QUERIES
from quarry.sources.catalog import IndexCatalog, IndexChanged, IndexNotFound
from quarry.sources.files import (list_source_files, nest_eval_results, read_eval_queries, read_history,
                                  read_text_documents, write_eval_results)
from quarry.sources.tables import query_set, records


def test_list_and_read_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hello\nworld", encoding="utf-8")
    (tmp_path / ".hidden").write_text("x")
    (tmp_path / "b.md").write_text("# t")
    names = sorted(r.name for r in list_source_files(spark, str(tmp_path)).collect())
    assert names == ["a.txt", "b.md"]
    docs = read_text_documents(spark, str(tmp_path / "a.txt")).collect()
    assert [d.text for d in docs] == ["hello\nworld"]
    with pytest.raises(ValueError):
        read_text_documents(spark, str(tmp_path / "b.md"))


def test_history_and_eval_files(spark, tmp_path):
    msgs = [{"role": "system", "content": "s"}, {"role": "user", "content": "q"},
            {"role": "assistant", "content": "a", "metadata": {"k": "v"}}]
    (tmp_path / "h.json").write_text(json.dumps(msgs))
    rows = read_history(spark, str(tmp_path / "h.json")).orderBy("turn").collect()
    assert [(r.turn, r.role, r.text) for r in rows] == [(0, "system", "s"), (1, "user", "q"), (2, "assistant", "a")]
    assert read_eval_queries(spark, str(tmp_path / "missing.json")).count() == 0
    (tmp_path / "q.json").write_text(json.dumps([{"QueryId": 1, "QueryText": "x"}]))
    assert read_eval_queries(spark, str(tmp_path / "q.json")).collect()[0].query_text == "x"
    flat = spark.createDataFrame([(1, "x", 2, "d2", "t2", 0.5, None), (1, "x", 1, "d1", "t1", 0.9, 3)],
                                 "query_id int, query string, rank int, document_id string, "
                                 "extracted_text string, score double, is_relevant int")
    path = write_eval_results(nest_eval_results(flat), str(tmp_path / "eval"), "run1")
    back = spark.read.json(path).collect()[0]
    assert [d.DocumentId for d in back.Results] == ["d1", "d2"]
    with pytest.raises(Exception):
        write_eval_results(nest_eval_results(flat), str(tmp_path / "eval"), "run1")


def test_catalog(spark, tmp_path):
    cat = IndexCatalog(spark, prefix="test-", root=str(tmp_path / "idx"))
    recs = spark.createDataFrame([("1", None, ["a"], "x", "{}")],
                                 "id string, embedding array<float>, tags array<string>, content string, payload string")
    with pytest.raises(IndexNotFound):
        cat.upsert("My Index", recs)
    assert cat.read("My Index").count() == 0
    cat.create("My Index")
    cat.create("My Index")
    assert "my-index" in cat.list() and cat.exists("my index")
    cat.upsert("My Index", recs)
    cat.upsert("My Index", recs)
    assert cat.read("my index").count() == 1
    cat.delete("my index", spark.createDataFrame([("1",)], "id string"))
    assert cat.read("my index").count() == 0
    cat.drop_all()
    assert cat.list() == []
    cat.drop("my index")


def test_payload_field(spark):
    df = spark.createDataFrame([('{"source": "s1", "n": 3}',)], "payload string")
    assert df.select(payload_field("source")).first()[0] == "s1"


def test_approx_recall(spark):
    rnd = random.Random(3)
    recs = spark.createDataFrame([(str(i), [rnd.gauss(0, 1) for _ in range(8)]) for i in range(400)],
                                 "id string, embedding array<float>")
    qs = spark.createDataFrame([(j, [rnd.gauss(0, 1) for _ in range(8)]) for j in range(10)],
                               "query_id int, query_vec array<float>")
    exact = {(r.query_id, r.id) for r in vector_candidates(recs, qs, 10).collect()}
    approx = {(r.query_id, r.id) for r in approx_vector_search(recs, qs, 10, parts=4, codes=64, rerank=40).collect()}
    assert len(exact & approx) / len(exact) >= 0.9


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_approx_recall_of_the_registered_query(spark, sf):
    exact = {(r.query_id, r.id) for r in vector_candidates(records(spark, sf), query_set(spark, sf), 5).collect()}
    approx = {(r.query_id, r.id) for r in QUERIES["approx_vector_top_k"](spark, sf).collect()}
    assert exact and len(exact & approx) / len(exact) >= 0.9


def test_embedder_and_search(spark):
    docs = spark.createDataFrame([("1", "le chat noir dort"), ("2", "un chien court"), ("3", "chat et chien")],
                                 "id string, content string")
    embed = hashing_embedder(32)(docs)
    recs = embed(docs).select("id", "embedding", F.array(F.lit("k:v")).alias("tags"), "content",
                              F.lit("{}").alias("payload"))
    qs = embed(spark.createDataFrame([(1, "chat noir")], "query_id int, content string"))
    qs = qs.select("query_id", F.col("content").alias("query_text"), F.col("embedding").alias("query_vec"))
    out = search(recs, qs, 2, use_normalization=True).orderBy("rank").collect()
    assert out[0].id == "1" and len(out) == 2


def _pack(lines, m):
    out, cur, n = [], [], 0
    for ln in lines:
        w = ln.split()
        pieces = [" ".join(w[i:i + m]) for i in range(0, len(w), m)] if len(w) > m else [ln]
        for p in pieces:
            k = len(p.split())
            if cur and n + k <= m:
                cur.append(p)
                n += k
            else:
                if cur:
                    out.append("\n".join(cur))
                cur, n = [p], k
    if cur:
        out.append("\n".join(cur))
    return out


def test_token_pack_matches_brute_force(spark):
    rnd = random.Random(5)
    lines = [" ".join("w%d" % rnd.randint(0, 9) for _ in range(rnd.randint(1, 12))) for _ in range(40)]
    docs = spark.createDataFrame([(1, "# H\n" + "\n".join(lines))], "doc_id int, text string")
    got = [r.text for r in token_pack(markdown_sections(docs), 10).orderBy("chunk_no").collect()]
    assert got == _pack(lines, 10)


def test_saved_index_equals_lazy(spark, tmp_path):
    from quarry.operators import text_search as ts
    from quarry.sources.tables import query_set, records
    sf = "/root/testdata/sf0.001"
    r, q = records(spark, sf), query_set(spark, sf)
    lazy = {(x.query_id, x.id, round(x.text_score, 9)) for x in ts.text_search(r, q).collect()}
    saved = ts.LexemeIndex.build(r).save(str(tmp_path / "idx"), n_files=4)
    got = {(x.query_id, x.id, round(x.text_score, 9)) for x in ts.text_search(r, q, index=saved).collect()}
    assert got == lazy and len(lazy) > 0
    # the short-set path (literal IN) and the long-set path (semi-join) agree
    few = sorted({x.lexeme for x in saved.terms.select("lexeme").distinct().limit(300).collect()})
    a = ts.keep_lexemes(saved.terms, few[:100]).count()
    b = ts.keep_lexemes(saved.terms, few[:100] + ["zz-not-a-word-%d" % i for i in range(300)]).count()
    assert a == b


def test_sinks_and_pairs(spark, tmp_path):
    from quarry.functions.tags import tags_to_pairs
    from quarry.sources.files import history_file_stem, write_chunks, write_history
    df = spark.createDataFrame([({"type": "news", "lang": "fr"},)], "m map<string,string>")
    assert sorted(df.select(tags_to_pairs("m")).first()[0]) == ["lang:fr", "type:news"]
    chunks = spark.createDataFrame([("p1", 0, "a"), ("p1", 1, "b"), ("p2", 0, "c")],
                                   "parent_id string, partition_number int, text string")
    write_chunks(chunks, str(tmp_path / "chunks"))
    back = spark.read.parquet(str(tmp_path / "chunks"))
    assert sorted((r.parent_id, r.text) for r in back.collect()) == [("p1", "a"), ("p1", "b"), ("p2", "c")]
    msgs = spark.createDataFrame([("c1", 0, "user", "hi", {}), ("c1", 1, "assistant", "yo", {"k": "v"})],
                                 "conv_id string, turn int, role string, text string, metadata map<string,string>")
    write_history(msgs, str(tmp_path / "hist"))
    assert spark.read.json(str(tmp_path / "hist")).count() == 2
    stem = spark.range(1).select(history_file_stem()).first()[0]
    assert stem.startswith("ChatHistory-") and stem.endswith(".json") and len(stem) == len("ChatHistory-dd-MM-yy-HHmm.json")
    assert spark.range(1).select(history_file_stem("notes")).first()[0] == "notes.json"
    assert spark.range(1).select(history_file_stem("notes.txt")).first()[0] == "notes.txt"


def test_chunk_files_routes_each_row(spark, tmp_path):
    from quarry.operators.loading import chunk_files, unsupported_files
    (tmp_path / "a.txt").write_text("x" * 1500, encoding="utf-8")
    (tmp_path / "b.md").write_text("# T\nbody\n## U\nmore", encoding="utf-8")
    (tmp_path / "c.pdf").write_bytes(b"%PDF-1.4")
    (tmp_path / "d.html").write_text("<p>x</p>")
    files = spark.read.format("binaryFile").load(str(tmp_path))
    out = chunk_files(files, tags=["type:news"]).collect()
    by = {}
    for r in out:
        by.setdefault(r.name.split(".partition.")[0], []).append(r)
    assert sorted(by) == ["a.txt", "b.md"]
    assert sorted(r.name for r in by["a.txt"]) == ["a.txt.partition.0.txt", "a.txt.partition.1.txt"]
    assert [r.size for r in sorted(by["a.txt"], key=lambda r: r.partition_number)] == [1000, 700]
    assert sorted(r.text for r in by["b.md"]) == ["body", "more"]
    assert all(r.tags == [f"__document_id:{r.parent_id}", "type:news"] and r.mime_type == "text/plain" for r in out)
    skipped = sorted(r.name for r in unsupported_files(files).collect())
    assert skipped == ["c.pdf", "d.html"]
    ready = files.where(F.col("path").endswith("a.txt")).select(F.col("path").alias("document_id"))
    again = {r.name.split(".partition.")[0] for r in chunk_files(files, ready=ready).collect()}
    assert again == {"b.md"}
    (tmp_path / "e.xyz").write_text("?")
    with pytest.raises(Exception, match="File type not supported"):
        chunk_files(spark.read.format("binaryFile").load(str(tmp_path)), strict=True).collect()


def _folders(cat, index):
    return cat._manifest(index, cat.version(index))


def _plain(spark, n, content="c"):
    return spark.range(n).selectExpr("CAST(id AS STRING) AS id", "CAST(NULL AS ARRAY<FLOAT>) AS embedding",
                                     "array('k:v') AS tags", f"'{content}' AS content", "'{}' AS payload")


def test_an_upsert_writes_touched_buckets_only(spark, tmp_path):
    cat = IndexCatalog(spark, prefix="b-", root=str(tmp_path / "idx"), buckets=8)
    cat.drop_all()
    cat.create("big")
    cat.upsert("big", _plain(spark, 2000))
    before = _folders(cat, "big")
    assert sorted(before) == list(range(8))
    cat.upsert("big", _plain(spark, 2000, "new").where("id = '77'"))
    after = _folders(cat, "big")
    assert len({b for b in before if before[b] != after[b]}) == 1 and sorted(after) == sorted(before)
    assert cat.read("big").count() == 2000
    assert [r.id for r in cat.read("big").where("content = 'new'").collect()] == ["77"]
    # the new version holds one bucket folder only
    writes = [p for p in (tmp_path / "idx" / "b-big" / "data").iterdir()]
    assert sorted(len([x for x in p.iterdir() if x.name.startswith("bucket=")]) for p in writes) == [1, 8]
    cat.delete("big", spark.createDataFrame([("78",), ("none",)], "id string"))
    assert cat.read("big").count() == 1999
    cat.drop_all()


def test_old_versions_and_dropped_indexes_leave_no_files(spark, tmp_path):
    cat = IndexCatalog(spark, prefix="v-", root=str(tmp_path / "idx"), buckets=2)
    cat.drop_all()
    cat.create("one")
    base = tmp_path / "idx" / "v-one"
    cat.upsert("one", _plain(spark, 40, "a"))
    held = cat.read("one")
    cat.upsert("one", _plain(spark, 40, "b"))
    assert {r.content for r in held.collect()} == {"a"}  # one version before the current one
    with cat.snapshot("one") as leased:
        for k in range(4):
            cat.upsert("one", _plain(spark, 40, f"c{k}"))
        assert {r.content for r in leased.collect()} == {"b"}
    cat.upsert("one", _plain(spark, 40, "d"))
    assert len(list((base / "manifest").iterdir())) == 2 and len(list((base / "data").iterdir())) == 2
    assert not list(p for p in (base / "leases").iterdir() if not p.name.startswith("."))
    assert {r.content for r in cat.read("one").collect()} == {"d"}
    # another root of the same name does not lead to another folder
    other = IndexCatalog(spark, prefix="v-", root=str(tmp_path / "elsewhere"), buckets=5)
    other.upsert("one", _plain(spark, 1, "e"))
    assert cat.read("one").where("content = 'e'").count() == 1 and not (tmp_path / "elsewhere").exists()
    cat.drop("one")
    assert not any(p.is_file() and p.suffix == ".parquet" for p in (tmp_path / "idx").rglob("*"))


def test_a_change_is_one_step(spark, tmp_path):
    cat = IndexCatalog(spark, prefix="s-", root=str(tmp_path / "idx"), buckets=3)
    cat.drop_all()
    cat.create("one")
    cat.upsert("one", _plain(spark, 30, "old"))
    version = cat.version("one")
    cat.apply("one", upserts=_plain(spark, 3, "new"), deletes=spark.range(2, 10).selectExpr("CAST(id AS STRING) AS id"))
    assert sorted((int(r.id), r.content) for r in cat.read("one").collect()) == (
        [(k, "new") for k in range(3)] + [(k, "old") for k in range(10, 30)])
    assert cat.version("one") != version
    with pytest.raises(Exception, match="without an id"):
        cat.upsert("one", _plain(spark, 1).withColumn("id", F.lit(None).cast("string")))
    assert cat.read("one").count() == 23
    cat.delete("one", cat.read("one").select("id"))
    assert cat.read("one").count() == 0 and cat.read("one", with_embeddings=False).columns == ["id", "tags", "content", "payload"]
    cat.apply("one")
    cat.upsert("one", _plain(spark, 0))
    with pytest.raises(IndexNotFound):
        cat.apply("two", upserts=_plain(spark, 1))
    cat.delete("two", spark.createDataFrame([("1",)], "id string"))
    cat.drop_all()


def test_a_lost_race_is_an_error(spark, tmp_path, monkeypatch):
    cat = IndexCatalog(spark, prefix="r-", root=str(tmp_path / "idx"), buckets=2)
    cat.drop_all()
    cat.create("one")
    cat.upsert("one", _plain(spark, 4, "a"))
    wrote = cat._write_manifest

    def overtaken(index, folders):
        monkeypatch.setattr(cat, "_write_manifest", wrote)
        cat.upsert("one", _plain(spark, 1, "first"))
        return wrote(index, folders)

    monkeypatch.setattr(cat, "_write_manifest", overtaken)
    with pytest.raises(IndexChanged):
        cat.upsert("one", _plain(spark, 4, "second"))
    assert sorted(r.content for r in cat.read("one").collect()) == ["a", "a", "a", "first"]
    cat.drop_all()


def test_text_files_need_no_folder_each(spark, tmp_path, monkeypatch):
    """Every source and block is a file, none a folder; names that paths would escape come back."""
    import hashlib
    import os

    from quarry.plans import stores

    rows = [(k, f"text é {k}\n", s) for k, s in zip(range(0, 1500, 25), ["src0", "a/b %c", "", None, "é*=+"] * 12)] + [(-3, None, "src0")]
    rows += [(0, "text é 0\n", "src0")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(stores, "scratch_path", lambda spark, name: str(tmp_path / f"{name}-1"))
    got = sorted(map(tuple, stores.text_files(spark, str(tmp_path)).collect()))
    want = {}
    for k, t, s in sorted(rows, key=lambda r: r[0]):
        want.setdefault(("none" if s is None else s, k // 50), []).append((t or "") + "\n")
    joined = {k: "".join(v).encode() for k, v in want.items()}
    assert got == sorted((*k, len(v), hashlib.sha256(v).hexdigest()) for k, v in joined.items())
    folders = [d for d, _, files in os.walk(tmp_path / "texts-1") if any(f.endswith(".txt") for f in files)]
    assert len(folders) == len({s for s, _ in want})
