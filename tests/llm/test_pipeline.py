"""The pipeline's stages take effect, in order, on whole rows."""

import corpus_pipeline
from quarry.llm.common import stored

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, rows = docs.columns, {tuple(r) for r in docs.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]
    sizes = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, SF), "test-stage")
        assert docs.columns == columns
        got = [tuple(r) for r in docs.collect()]
        assert set(got) <= rows
        if name != "mixing":
            assert len(got) == len(set(got))
            rows = set(got)
        sizes.append(len(got))
    assert sizes[0] > sizes[1] > sizes[2] > 0.5 * sizes[0] and sizes[3] > sizes[2]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert sorted(tuple(r)[:len(columns)] for r in last) == sorted(got)
    assert len({(r.shard, r.slot) for r in last}) == len(last)


def test_registered(spark):
    names = set(E.queries())
    assert "pipeline" in names
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), "test-stage")
        assert docs.count() == 0
