"""K-d tree shards: balance, togetherness, slots and edges."""

import zlib
from collections import Counter, defaultdict

import pyarrow.parquet as pq

from quarry.llm import sharding

SF = "/root/testdata/sf0.001"


def check(spark, rows, n_shards=8, slack=0.01):
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string, __q_size2 int")
    got = sharding.shard_report(df, n_shards=n_shards).collect()
    text = lambda t: (t or "").encode()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter(
        (r[0], len(text(r[1])) + 1, zlib.crc32(text(r[1]))) for r in rows)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    assert all(0 <= s < n_shards for s in by)
    for part in by.values():
        assert sorted(r.slot for r in part) == list(range(len(part)))
    total = sum(r.size for r in got)
    groups = Counter()
    for r in rows:
        groups[text(r[1])] += len(text(r[1])) + 1
    limit = total / n_shards / 20
    unit = max([len(text(r[1])) + 1 for r in rows] + [limit], default=0)
    for part in by.values():
        assert abs(sum(r.size for r in part) - total / n_shards) <= 3 * unit + slack * total / n_shards
    where = defaultdict(set)
    for r in got:
        where[r.text_crc32, r.size].add(r.shard)
    for t, w in groups.items():
        if w <= limit:
            assert len(where[zlib.crc32(t), len(t) + 1]) == 1
    return by


def test_whole_table(spark):
    t = pq.read_table(f"{SF}/documents.parquet").to_pydict()
    rows = [(i, x, "c", 1) for i, x in zip(t["doc_id"], t["text"])]
    check(spark, rows)
    check(spark, rows, 5)
    check(spark, rows, 1)


def test_hot_group_and_edges(spark):
    rows = [(k, f"text {k} " * (1 + k % 13)) for k in range(400)] + [(1000 + k, "the same text here") for k in range(400)]
    rows += [(None, None), (None, ""), (5, ""), (5, ""), (6, "é" * 50)]
    check(spark, [(*r, "x", 1) for r in rows])


def test_equal_rows_and_empty(spark):
    rows = [(1, "same", None, None)] * 50
    df = spark.createDataFrame(rows, "doc_id long, text string, a string, b string")
    got = sharding.shard_report(df).collect()
    assert sorted((r.shard, r.slot) for r in got) == sorted({(r.shard, r.slot) for r in got}) and len(got) == 50
    assert sharding.shard_report(df.limit(0)).collect() == []
    assert sharding.sharded_documents(df.limit(0)).collect() == []


def test_documents_and_target_bytes(spark):
    rows = [(k, "word " * (10 + k % 50), f"s{k}") for k in range(300)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, Slot string")
    got = sharding.sharded_documents(df, n_shards=None, target_bytes=20_000)
    assert got.columns == ["doc_id", "text", "shard", "slot"]
    out = got.collect()
    assert Counter((r.doc_id, r.text) for r in out) == Counter((r[0], r[1]) for r in rows)
    by = defaultdict(list)
    for r in out:
        by[r.shard].append(r)
    assert len(by) == -(-sum(len(r[1]) + 1 for r in rows) // 20_000)
    for part in by.values():
        assert sorted(r.slot for r in part) == list(range(len(part)))
        assert sum(len(r.text) + 1 for r in part) < 22_000


def test_few_keys_need_no_further_passes(spark, monkeypatch):
    from pyspark.sql import functions as F

    rows = [(k, "".join("a é\n"[(k * j) % 4] for j in range(1 + k * k % 97))) for k in range(900)]
    rows += [(2000 + k, "one text of many copies " * 4) for k in range(300)] + [(None, None), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    measured = sharding.stored(df.select(*[c.alias(k) for k, c in sharding._measured(df, "doc_id", "text").items()]), "kd-test")
    collects, collect = [0], type(df).collect

    def counted(frame):
        collects[0] += 1
        return collect(frame)

    monkeypatch.setattr(type(df), "collect", counted)
    for shards in (2, 5, 8):
        collects[0] = 0
        tree = sharding.grow_tree(measured, shards)
        # per level: the extents, one pass and the keys of its bins; before: the groups of copies
        # and, as first() collects too, the corpus extent
        assert collects[0] <= 3 * len(tree.levels) + 2
        with monkeypatch.context() as m:
            m.setattr(sharding, "FEW", -1)
            assert sharding.grow_tree(measured, shards) == tree
    assert measured.where(F.col("__q_size") > 1).count() > 1000
