"""Keyed state of the streaming ingest: documents seen before, changes, eviction, restart."""

import time

from pyspark.sql import functions as F

from quarry.streaming.ingest import read_merged, start_ingest


def _put(spark, src, name, rows):
    spark.createDataFrame(rows, "doc_id long, text string, n_chars long").coalesce(1).write.parquet(f"{src}/{name}")


def _run(spark, tmp_path, **options):
    query = start_ingest(spark, f"{tmp_path}/src/*", f"{tmp_path}/out", f"{tmp_path}/cp", file_pattern="*.parquet", **options)
    query.awaitTermination()
    return query


def _epochs(spark, tmp_path):
    return sorted((r.parent_id, r.epoch) for r in spark.read.parquet(f"{tmp_path}/out-parents").collect())


def _state_rows(query):
    return [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]


def test_a_document_sent_twice_is_chunked_once(spark, tmp_path):
    _put(spark, f"{tmp_path}/src", "a", [(1, "x" * 2500, None), (2, "y", 1), (2**60 + 1, "big", 2)])
    _run(spark, tmp_path)
    _put(spark, f"{tmp_path}/src", "b", [(1, "x" * 2500, None), (2, "y", 1), (3, "new", None)])
    _run(spark, tmp_path)  # a restart from the checkpoint
    epochs = dict(_epochs(spark, tmp_path))  # one epoch each; runs without rows count epochs, too
    assert len(epochs) == len(_epochs(spark, tmp_path)) == 4 and epochs.pop("3") > 0 and set(epochs.values()) == {0}
    assert read_merged(spark, f"{tmp_path}/out").groupBy("parent_id").count().where("parent_id = '1'").first()[1] == 3
    # changed, and changed back: both count
    _put(spark, f"{tmp_path}/src", "c", [(2, "z", 1)])
    _run(spark, tmp_path)
    _put(spark, f"{tmp_path}/src", "d", [(2, "y", 1)])
    _run(spark, tmp_path)
    last = read_merged(spark, f"{tmp_path}/out").where("parent_id = '2'").collect()
    assert [r.text for r in last] == ["y"]
    assert len([e for p, e in _epochs(spark, tmp_path) if p == "2"]) == 3


def test_rows_that_repeat_in_a_batch(spark, tmp_path):
    _put(spark, f"{tmp_path}/src", "a", [(1, "old", 1)])
    _run(spark, tmp_path)
    _put(spark, f"{tmp_path}/src", "b", [(1, "old", 1), (1, "new", 1), (1, "new", 1), (None, "no id", 1), (4, None, 1)])
    _run(spark, tmp_path)
    rows = read_merged(spark, f"{tmp_path}/out").collect()
    assert [r.text for r in rows if r.parent_id == "1"] == ["new"]


def test_state_is_bounded(spark, tmp_path):
    """With a short memory, documents of earlier batches leave the state."""
    total, held = 0, []
    for k in range(4):
        _put(spark, f"{tmp_path}/src", f"f{k}", [(100 * k + j, f"text {k} {j}", 1) for j in range(50)])
        total += 50
        query = _run(spark, tmp_path, seen_for="1 second")
        held.append(_state_rows(query)[-1])
        time.sleep(2)
    assert total == 200 and max(held) <= 100
    assert read_merged(spark, f"{tmp_path}/out").select(F.countDistinct("parent_id")).first()[0] == 200
