"""Token planes: exact round trip, whole-text encoding, order and edges."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from quarry.llm import token_files as K
from quarry.session import scratch_path

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def plain(tokenizer, text):
    return np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], np.uint32).tobytes()


TRICKY = ["", " ", "  two  spaces ", "a\nb", "a \nb", "a\n b", "tab\tx y", "don't stop it's we're", "x.\nY z", "x.\n\nY z",
          "é ǘ áb c", "123 4a a4 a_b _x", "...a b... ?! x!? y.", "a b c  d", "a　b 　c", "\x00 a \x00b",
          "<|endoftext|> x<|endoftext|>y", "日本 語", "a²b c² ²", "Ⅷ x", "'s 's x'", "a' b", "\x1c a", "x​ y", "word " * 2000,
          "😀 a😀b", "a.b c,d e", "foo.\nBar, baz", "Ġx yĠ", "a\r\nb c", "end\n", "\nstart x", "-a b- c-d"]


def test_pieces_equal_whole_texts(tokenizer):
    texts = TRICKY + pq.read_table(f"{SF}/documents.parquet")["text"].to_pylist()
    encoder = K.Encoder(PATH)
    assert encoder.encode(texts) == [plain(tokenizer, t) for t in texts]
    assert encoder.encode(texts[::-1]) == [plain(tokenizer, t) for t in texts[::-1]]  # now from memory


@pytest.mark.parametrize("block", [1, 7, 32_768])
def test_planes_round_trip(block):
    for n in (0, 1, 6, 7, 8, 50):
        ids = np.arange(n, dtype=np.uint32) * np.uint32(80_000_001)
        planes = K.to_planes(ids.tobytes(), block)
        assert len(planes) == 4 * -(-n // block)
        assert K.from_planes(planes) == ids.tobytes()


def check(spark, tokenizer, rows, **options):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, start string, shard int")
    got = K.token_report(df, PATH, **options).collect()
    want = [(i, plain(tokenizer, t)) for i, t in rows]
    assert sorted((repr(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted(
        (repr(i), len(x) // 4, zlib.crc32(x)) for i, x in want)
    got.sort(key=lambda r: r.start)
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens


def test_whole_table(spark, tokenizer):
    t = pq.read_table(f"{SF}/documents.parquet").to_pydict()
    check(spark, tokenizer, list(zip(t["doc_id"], t["text"])), block=1000, chunk_ids=5000)


def test_edges(spark, tokenizer):
    rows = [(5 + k, t) for k, t in enumerate(TRICKY)] + [(None, None), (None, "a"), (3, "dup x"), (3, "dup x"), (3, "other"),
                                                         (900, "long text here " * 30_000)]
    check(spark, tokenizer, rows, chunk_ids=64)
    check(spark, tokenizer, [])


def test_ids_read_back(spark, tokenizer):
    rows = [(k, f"text number {k}") for k in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    path = K.write_tokens(df, scratch_path(spark, "test-tokens"), PATH, end_id=50256)
    got = {r.doc_id: np.frombuffer(r.ids, np.uint32) for r in K.read_tokens(spark, path).collect()}
    for i, t in rows:
        assert list(got[i][:-1]) == tokenizer.encode(t).ids and got[i][-1] == 50256
