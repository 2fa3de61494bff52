"""Registered round trips: indexes, files and chunk stores written, read back, and returned."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.mime import path_name
from quarry.functions.tags import tags_to_pairs
from quarry.operators.chunking import fixed_window_chunks
from quarry.operators.fusion import fuse
from quarry.plans.common import QUERY_SET_CTE, RECORDS_CTE, SCORED_CTE
from quarry.operators.text_search import text_matches
from quarry.operators.vector_search import vector_candidates
from quarry.plans.text import TEXT_CTES, text_index
from quarry.session import list_shared, scratch_path, touch_shared
from quarry.sources.catalog import IndexCatalog
from quarry.sources.files import (folder_name, from_folder_name, list_source_files, nest_eval_results, read_chunks,
                                  read_eval_queries, read_history, read_text_documents, write_chunks, write_eval_results,
                                  write_history, write_text_files)
from quarry.sources.tables import query_set, read_table, records


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _catalog(spark: SparkSession, buckets: int = 16) -> IndexCatalog:
    """A catalog of its own, so that runs do not meet."""
    root = scratch_path(spark, "indexes")
    return IndexCatalog(spark, prefix=f"run-{root[-12:]}-", root=root, buckets=buckets)


def index_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """All records into an index; then, in one change, the labelled ones anew and the toxic ones out."""
    catalog = _catalog(spark)
    catalog.create("Main Index")
    catalog.upsert("main_index", records(spark, sf))
    labels = read_table(spark, sf, "labels", widen=False)
    anew = catalog.read("main-index").join(labels.select(F.col("doc_id").cast("string").alias("id"), "quality"), "id")
    anew = anew.withColumn("payload", F.concat(F.lit('{"quality":'), F.col("quality").cast("string"), F.lit("}"))).drop("quality")
    toxic = labels.where("toxic = 1").select(F.col("doc_id").cast("string").alias("id"))
    catalog.apply("main.index", upserts=anew.join(toxic, "id", "left_anti"), deletes=toxic)
    out = _stored(catalog.read("MAIN INDEX").select(
        "id", F.array_join("tags", "|").alias("tags"), "payload", F.sha2("content", 256).alias("content_sha256"),
        F.coalesce(F.size("embedding"), F.lit(0)).alias("vector_size")), "index-rows")
    catalog.drop_all()
    return out


def index_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """One index a language: what is listed and held after each step."""
    catalog = _catalog(spark, 4)
    rec = records(spark, sf)
    langs = sorted(r.lang for r in read_table(spark, sf, "documents", widen=False).select("lang").distinct().collect() if r.lang)
    steps = []
    for lang in langs:
        catalog.create(f"Docs {lang}")
        catalog.upsert(f"Docs {lang}", rec.where(F.array_contains("tags", f"lang:{lang}")))
        catalog.create(f"docs/{lang}")  # there already: nothing happens
    for name in catalog.list():
        steps.append(catalog.read(name, with_embeddings=False).agg(F.count("*").alias("n_records"))
                     .select(F.lit("made").alias("step"), F.lit(name).alias("index_name"), "n_records"))
    out = _stored(_union(steps), "catalog-made")
    catalog.drop(f"docs_{langs[0]}")
    left = [(("dropped one"), name) for name in catalog.list() if catalog.exists(name)]
    catalog.drop_all()
    left += [("dropped all", name) for name in catalog.list()]
    after = spark.createDataFrame(left, "step string, index_name string").withColumn("n_records", F.lit(None).cast("long"))
    return out.unionByName(after)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def history_files(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations written as JSON files, one each, and read back."""
    path = scratch_path(spark, "history")
    write_history(read_table(spark, sf, "conversations").select("conv_id", "turn", "role", "text"), path)
    back = read_history(spark, path)
    return back.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", F.sha2("text", 256).alias("text_sha256"),
                       "has_function_item", F.size("metadata").alias("n_metadata"))


TEXT_FILE = 50  # documents of one source to a file


def text_files(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as text files, listed and read whole."""
    path = scratch_path(spark, "texts")
    block = F.floor(F.col("doc_id") / TEXT_FILE).cast("string")
    file = F.concat(F.lit("source="), folder_name(F.coalesce("source", F.lit("none"))),
                    F.lit("/block="), F.coalesce(block, F.lit("none")), F.lit(".txt"))
    write_text_files(read_table(spark, sf, "documents", widen=False).select(
        file.alias("file"), "doc_id", F.coalesce("text", F.lit("")).alias("value")), path)
    if not list_shared(spark, path):  # no documents, no folder
        touch_shared(spark, f"{path}/.empty")
    files = list_source_files(spark, path, recursive=True).where(F.col("name").endswith(".txt"))
    texts = read_text_documents(spark, path, recursive=True)
    part = lambda name, end: F.regexp_extract("path", f"/{name}=([^/]*){end}", 1)
    tail = lambda c: F.substring_index(c, "/texts-", -1)  # noqa: E731 - listing and input_file_name write schemes differently
    listed = files.select(tail("path").alias("tail"), F.col("length").alias("file_bytes"), path_name(F.col("path")).alias("name"))
    texts = texts.select("path", tail("path").alias("tail"), F.sha2("text", 256).alias("text_sha256"))
    return (texts.join(listed, "tail").select(from_folder_name(part("source", "/")).alias("source"),
                                              part("block", r"\.txt$").try_cast("bigint").alias("block"), "file_bytes", "text_sha256"))


def eval_query_files(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark items as evaluation questions, written as JSON arrays (twenty questions each)
    and read back."""
    path = scratch_path(spark, "eval-queries")
    question = F.struct(F.col("item_id").cast("int").alias("QueryId"), F.col("text").alias("QueryText"))
    (read_table(spark, sf, "benchmark").groupBy(F.floor(F.col("item_id") / 20).alias("file"))
     .agg(F.to_json(F.collect_list(question)).alias("value")).repartition("file").write.partitionBy("file").text(path))
    return read_eval_queries(spark, path).select(F.col("query_id").cast("long").alias("query_id"), F.sha2("query_text", 256).alias("text_sha256"))


def eval_result_files(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest records of every question, judged at odd ranks, as a nested result file."""
    near = vector_candidates(records(spark, sf), query_set(spark, sf), 4)
    flat = near.select("query_id", F.concat(F.lit("q"), F.col("query_id").cast("string")).alias("query"), "rank",
                       F.col("id").alias("document_id"), F.lit("").alias("extracted_text"),
                       (F.lit(1.0) - F.col("distance")).alias("score"),
                       F.when(F.col("rank") % 2 == 1, 3).alias("is_relevant"))
    path = write_eval_results(nest_eval_results(flat), scratch_path(spark, "eval-results"), "run")
    back = spark.read.schema("QueryId long, Query string, Results array<struct<Rank:int,DocumentId:string,IsRelevant:int>>").json(path)
    return back.select(F.col("QueryId").alias("query_id"), F.col("Query").alias("query"), F.explode("Results").alias("r")).select(
        "query_id", "query", F.col("r.Rank").alias("rank"), F.col("r.DocumentId").alias("document_id"), F.col("r.IsRelevant").alias("is_relevant"))


def chunk_store(spark: SparkSession, sf: str) -> DataFrame:
    """All documents chunked and stored; those of label 0 again in upper case, the toxic ones as empty texts."""
    path = scratch_path(spark, "chunk-store")
    docs = read_table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("parent_id"), "text")
    chunked = lambda df: fixed_window_chunks(df, key="parent_id")
    write_chunks(chunked(docs), path, docs)
    labels = read_table(spark, sf, "labels", widen=False)
    again = docs.join(labels.where("quality = 0 OR toxic = 1").select(F.col("doc_id").cast("string").alias("parent_id"), "toxic"), "parent_id")
    again = again.select("parent_id", F.when(F.col("toxic") == 1, "").otherwise(F.concat(F.lit("again "), F.substring("text", 1, 500))).alias("text"))
    write_chunks(chunked(again), path, again)
    return read_chunks(spark, path).select("parent_id", "partition_number", F.sha2("text", 256).alias("text_sha256"))


def tag_pairs(spark: SparkSession, sf: str) -> DataFrame:
    d = read_table(spark, sf, "documents")
    tags = F.create_map(F.lit("lang"), F.coalesce("lang", F.lit("")), F.lit("source"), F.coalesce("source", F.lit("")))
    return d.select("doc_id", F.array_join(tags_to_pairs(tags), "|").alias("tags"))


def fused_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Rows per question and id of a fusion of all text matches with the 50 nearest records:
    every id once, whichever side it came from."""
    q = query_set(spark, sf)
    vec = vector_candidates(records(spark, sf), q, 50).select("query_id", "id", F.col("distance").alias("vec_score"))
    txt = text_matches(text_index(spark, sf), q).select("query_id", "id", F.lit(1.0).alias("text_score"))
    both = fuse(vec, txt, 1_000_000, "rrf")
    return both.groupBy("query_id", "id").agg(F.count("*").alias("n_rows"), F.max(F.col("vec_score").isNotNull()).alias("near"),
                                              F.max(F.col("text_score").isNotNull()).alias("matches"))


_TEXT = "coalesce(d.text, '')"

SQL = {
    "index_round_trip": f"""WITH {RECORDS_CTE}
SELECT id, array_to_string(tags, '|') AS tags,
       CASE WHEN l.doc_id IS NULL THEN payload ELSE '{{"quality":' || CAST(l.quality AS VARCHAR) || '}}' END AS payload,
       sha256(replace(coalesce(content, ''), chr(0), '')) AS content_sha256, coalesce(len(embedding), 0) AS vector_size
FROM records LEFT JOIN labels l ON CAST(l.doc_id AS VARCHAR) = id WHERE coalesce(l.toxic, 0) <> 1""",
    "index_catalog": """WITH l AS (SELECT 'docs-' || lower(lang) AS index_name, count(*) AS n_records FROM documents WHERE lang IS NOT NULL GROUP BY 1)
SELECT 'made' AS step, index_name, n_records FROM l
UNION ALL SELECT 'dropped one', index_name, NULL FROM l WHERE index_name > (SELECT min(index_name) FROM l)""",
    "history_files": """SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn, role, sha256(text) AS text_sha256,
       false AS has_function_item, 0 AS n_metadata FROM conversations""",
    "text_files": f"""SELECT coalesce(source, 'none') AS source, doc_id // {TEXT_FILE} AS block,
       CAST(sum(strlen({_TEXT}) + 1) AS BIGINT) AS file_bytes,
       sha256(string_agg({_TEXT} || chr(10), '' ORDER BY doc_id)) AS text_sha256 FROM documents d GROUP BY 1, 2""",
    "eval_query_files": "SELECT item_id AS query_id, sha256(text) AS text_sha256 FROM benchmark",
    "eval_result_files": f"""WITH {RECORDS_CTE}, {QUERY_SET_CTE}, {SCORED_CTE.format(where='')}
SELECT query_id, 'q' || CAST(query_id AS VARCHAR) AS query, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank,
       id AS document_id, CASE WHEN rank % 2 = 1 THEN 3 END AS is_relevant FROM scored QUALIFY rank <= 4""",
    "chunk_store": f"""WITH t AS (
  SELECT CAST(d.doc_id AS VARCHAR) AS parent_id, CASE WHEN l.toxic = 1 THEN '' WHEN l.quality = 0
         THEN 'again ' || substring(d.text, 1, 500) ELSE d.text END AS text
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
w AS (SELECT *, unnest(range(0, CASE WHEN length(text) > 0
         THEN 1 + CAST(ceil(greatest(length(text) - 1000, 0) / 800.0) AS BIGINT) ELSE 0 END)) AS partition_number FROM t)
SELECT parent_id, partition_number, sha256(substring(text, partition_number * 800 + 1, 1000)) AS text_sha256 FROM w""",
    "tag_pairs": "SELECT doc_id, 'lang:' || coalesce(lang, '') || '|source:' || coalesce(source, '') AS tags FROM documents",
    "fused_ids": f"""WITH {TEXT_CTES}, {SCORED_CTE.format(where='')},
v AS (SELECT query_id, id FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, id) <= 50),
b AS (SELECT query_id, id, true AS near, false AS matches FROM v UNION ALL SELECT query_id, id, false, true FROM matches)
SELECT query_id, id, CAST(1 AS BIGINT) AS n_rows, bool_or(near) AS near, bool_or(matches) AS matches FROM b GROUP BY 1, 2""",
}

QUERIES = {
    "index_round_trip": index_round_trip,
    "index_catalog": index_catalog,
    "history_files": history_files,
    "text_files": text_files,
    "eval_query_files": eval_query_files,
    "eval_result_files": eval_result_files,
    "chunk_store": chunk_store,
    "tag_pairs": tag_pairs,
    "fused_ids": fused_ids,
}
