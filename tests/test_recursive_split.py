"""The native recursive splitter equals the one for single strings."""

import random

import pytest

from quarry.operators.chunking import recursive_chunks, recursive_pieces, split_recursive


@pytest.mark.parametrize("size,overlap", [(10, 3), (7, 0), (20, 19), (50, 10), (2, 1)])
def test_random_texts(spark, size, overlap):
    rng = random.Random(size)
    signs = ["ab", "c", "\n", "\n\n", ".", "\r", " ", "é", "\x1c", "word", "'", "\\n", "`"]
    texts = [None, "", " ", "a.b", "\n\n\n", "x" * 25, "a" * 9 + "\n\n" + "b" * 30 + ".c"]
    texts += ["".join(rng.choice(signs) for _ in range(rng.randint(0, 120))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, `my text` string")
    for r in df.select("doc_id", recursive_pieces("my text", size, overlap).alias("c")).collect():
        assert r.c == (split_recursive(texts[r.doc_id], size, overlap) if texts[r.doc_id] else [])


def test_no_python_in_the_plan(spark):
    df = recursive_chunks(spark.createDataFrame([(1, "a. b" * 2000)], "doc_id int, text string"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    assert [r.text for r in df.orderBy("partition_number").collect()] == split_recursive("a. b" * 2000)
    with pytest.raises(ValueError):
        recursive_pieces("text", 10, 10)
