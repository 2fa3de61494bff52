"""The registered queries: thin digests of the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import (
    decontaminate, fim, licenses, lm, mixing, quality_classifier, quality_rules, runs, sharding, simhash, token_files,
    toxicity, warc,
)
from quarry.llm.common import id_crc32, let, table, words
from quarry.llm.oracles import SQL  # noqa: F401 - registered beside the queries
from quarry.session import scratch_path


#: The vocabulary file of op5, in the folder of public tokenizers.
VOCABULARY = "byte_bpe_50k.json"


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op4_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    # which rule came first depends on measured costs; the verdict does not
    return quality_rules.quality_report(table(spark, sf_dir, "documents")).drop("rejected_by")


def op5_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_files.token_report(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op6_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard_report(table(spark, sf_dir, "documents"))
    return rows.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


def op7_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("start")


def op8_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(table(spark, sf_dir, "documents"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files ``source/lang/<doc_id div 20>/<doc_id>``."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", "lang", F.floor(F.col("doc_id") / 20).cast("string"), F.col("doc_id").cast("string"))
    return licenses.licenses(docs.withColumn("path", path))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fim.fill_in_middle(table(spark, sf_dir, "documents"))
    back = fim.restored(F.col("output"), F.col("form"))
    return rows.select("doc_id", "n", "form", F.length("prefix").cast("long").alias("prefix_chars"),
                       F.length("middle").cast("long").alias("middle_chars"), F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(back, 256).alias("restored_sha256"))


def op12_warc_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    packages = warc.write_packages(table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))
    tasks = warc.tasks_for(packages)
    records = warc.read_records(warc.read_index(packages, tasks), tasks)
    return records.select(F.col("id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                          F.col("refers_to").cast("long").alias("refers_to"))


def periodic_texts(docs: DataFrame) -> DataFrame:
    """The documents, every tenth by crc32 of its id made periodic from a word on."""
    h = id_crc32("doc_id")
    g = F.floor(h / 10)

    def altered(w):
        n = F.size(w)
        a = (g % n).cast("int")
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8)).cast("int")
        return F.array_join(F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, a + (i - a) % p))), " ")

    text = F.when(h % 10 == 0, let(words(F.col("text")), altered)).otherwise(F.col("text"))
    return docs.select("doc_id", text.alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(periodic_texts(table(spark, sf_dir, "documents")))
    found = found.withColumn("best", runs.strongest(F.col("runs")))
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
                        F.floor(F.col("best.length") * 1000 / F.col("best.period")).alias("exponent_milli"),
                        F.sha2(runs.listed(F.col("runs")), 256).alias("runs_sha256"),
                        F.sha2("collapsed", 256).alias("collapsed_sha256"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_simhash, op3_fair_mix, op4_quality_cascade, op5_token_planes,
                                   op6_kd_shards, op7_benchmark_leaks, op8_context_mixing, op9_licenses, op10_quality,
                                   op11_fill_in_middle, op12_warc_packages, op13_periodic_runs)}
