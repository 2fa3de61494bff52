"""Token ids as bit-plane shuffled, compressed binary chunks.

Documents are ranged by id and sorted; each partition becomes one shard of chunks,
written by Spark's own committer to any store Spark can write.  One row is a chunk:

    shard, chunk      place in the order of all ids
    n_ids             ids of the chunk
    doc_ids, lengths  documents of the chunk in order, ids of each (end id included)
    planes            for each block of ``block`` ids, four byte planes (lowest first):
                      byte k of every id of the block, compressed with zstandard

Chunks hold whole documents (at least one), so each row decodes alone; ``index`` sums
the counts to the place of every chunk.  All but the two low planes are zero for a
vocabulary below 65,536 and compress to a few bytes.

Encoding.  Byte-level pre-tokens never cross a space between two other characters, so
the text is cut there and each distinct piece is given to the tokenizers library
once per worker process (which remembers about ``PIECES``).  Other texts go to the
library whole.

Scale: texts are shuffled once; a task holds one Arrow batch, its piece memory and one
chunk.  A rerun of a lost task writes the same bytes.

Defined cases: NULL and empty texts are one end id; NULL ids come first, repeated ids
stand next to each other by text hash; a very long text makes a long chunk; an empty
table has no chunks.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import quoted, whole
from quarry.session import scratch_path

BLOCK, CHUNK, LEVEL, PIECES = 32_768, 262_144, 3, 1_300_000
SCHEMA = ("shard int, chunk int, n_ids long, doc_ids array<long>, lengths array<long>, block int, "
          "planes array<binary>")
#: White space next to which a space is no sure cut: every character that any common
#: definition counts as white space.
BLANKS = [chr(c) for c in range(0x3001) if chr(c).isspace() and c != 0x20]
#: Letters, marks, and perhaps the same again on the next line: each run is a pre-token.
PIECE = re.compile(r"(\x00?[^\W\d_]+)([^\w\s'\x00]*)(?:\n([^\W\d_]+)([^\w\s'\x00]*))?")


def regular(text: str) -> bool:
    """No space of the text touches white space or an end (and "\\0" is free as a sign)."""
    return not (not text or "\0" in text or text[0].isspace() or text[-1].isspace() or "  " in text
                or any(b in text and (f" {b}" in text or f"{b} " in text) for b in BLANKS))


#: The commonest marks after a word.
MARKS = frozenset(".,!?;:")


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit integers, an end id after each."""

    def __init__(self, path: str, end_id: int = 0):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.end = np.uint32(end_id).tobytes()
        self.known: dict[str, bytes] = {}
        # byte-level vocabularies write a space as U+0120
        self.spaced = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.spaced[[k for x, k in self.tokenizer.get_vocab().items() if x[:1] == "\u0120"]] = True

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, np.uint32).tobytes()
                for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_words(self, words: list[str], blank: str) -> list[bytes]:
        """Ids of words of letters, each after a space (part of its first token) or a line
        end (a token of its own, left out): one call, cut where a blank stands."""
        if not words:
            return []
        ids = np.array(self.tokenizer.encode_batch_fast([blank + blank.join(words)], add_special_tokens=False)[0].ids,
                       np.uint32)
        line = blank == "\n"
        starts = np.flatnonzero(ids == ids[0] if line else self.spaced[ids])
        if len(starts) != len(words):  # a vocabulary of another kind
            return self._encode([w if line else blank + w for w in words])
        data, ends = ids.tobytes(), 4 * np.r_[starts[1:], len(ids)]
        return [data[a:b] for a, b in zip((4 * (starts + line)).tolist(), ends.tolist())]

    def _learn(self, parts: set[str]) -> None:
        """Remember new pieces: what followed a space, or "\0" and a text's first piece."""
        known = self.known
        plain = list(filter(str.isalpha, parts))
        known.update(zip(plain, self._encode_words(plain, " ")))
        ended, runs, other = [], [], []  # a word and one mark; up to two words and their marks; the rest
        for p in parts.difference(plain):
            word = p[:-1]
            if p[-1:] in MARKS and word.isalpha():
                ended.append(p)
            elif (m := PIECE.fullmatch(p)) and m[1].lstrip("\0").isalpha() and (m[3] is None or m[3].isalpha()):
                runs.append((p, m[1], m[2], m[3] and "\0" + m[3], m[4]))
            else:
                other.append(p)
        words = {p[:-1] for p in ended}
        words.update(r[1] for r in runs)
        words.update(r[3] for r in runs if r[3])
        words = words.difference(known)
        spaced = [w for w in words if w[0] != "\0"]
        first = [w for w in words if w[0] == "\0"]
        known.update(zip(spaced, self._encode_words(spaced, " ")))
        known.update(zip(first, self._encode_words([w[1:] for w in first], "\n")))
        known.update(zip(other, self._encode([p[1:] if p[:1] == "\0" else " " + p for p in other])))
        marks = {p[-1] for p in ended}.union([r[2] for r in runs], [r[4] for r in runs if r[3]])
        mark, line = dict(zip(marks, self._encode(list(marks)))), self._encode(["\n"])[0]
        known.update([(p, known[p[:-1]] + mark[p[-1]]) for p in ended])
        known.update([(p, known[w] + mark[m] + line + known[v] + mark[n] if v else known[w] + mark[m])
                      for p, w, m, v, n in runs])

    def encode(self, texts: list[str]) -> list[bytes]:
        known = self.known
        pieces, odd, out = {}, [], [self.end] * len(texts)
        for k, text in enumerate(texts):
            if regular(text):
                pieces[k] = ("\0" + text).split(" ")
            elif text:
                odd.append(k)
        if len(known) > PIECES:
            known.clear()
        self._learn(set().union(*pieces.values()).difference(known))
        for k, parts in pieces.items():
            out[k] = b"".join(map(known.__getitem__, parts)) + self.end
        for k, ids in zip(odd, self._encode([texts[k] for k in odd])):
            out[k] = ids + self.end
        return out


def shared_encoder(path: str, end_id: int) -> Encoder:
    """One encoder per worker process: it hangs on the library's module, as functions
    (and their globals) arrive anew with every task."""
    import tokenizers

    held = tokenizers.__dict__.setdefault("_encoders_by_path", {})
    if (path, end_id) not in held:
        held[path, end_id] = Encoder(path, end_id)
    return held[path, end_id]


def to_planes(ids: bytes, block: int) -> list[bytes]:
    """Byte planes of fixed-size blocks, each compressed."""
    pack, out = zstandard.ZstdCompressor(level=LEVEL), []
    values = np.frombuffer(ids, np.uint32)
    for first in range(0, len(values), block):
        part = values[first:first + block]
        out += [pack.compress((part >> np.uint32(8 * k)).astype(np.uint8).tobytes()) for k in range(4)]
    return out


def from_planes(planes: list[bytes]) -> bytes:
    unpack = zstandard.ZstdDecompressor()
    blocks = []
    for first in range(0, len(planes), 4):
        columns = [np.frombuffer(unpack.decompress(p), np.uint8) for p in planes[first:first + 4]]
        part = columns[0].astype(np.uint32)
        for k in range(1, 4):
            if columns[k].any():
                part |= columns[k].astype(np.uint32) << np.uint32(8 * k)
        blocks.append(part.tobytes())
    return b"".join(blocks)


def _writer(tokenizer_path: str, end_id: int, block: int, chunk_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, number = TaskContext.get().partitionId(), 0
        encoder, schema = None, pa.schema([
            ("shard", pa.int32()), ("chunk", pa.int32()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
            ("lengths", pa.list_(pa.int64())), ("block", pa.int32()), ("planes", pa.list_(pa.binary()))])
        ids, docs, held = [], [], 0

        def chunk() -> pa.RecordBatch:
            row = {"shard": shard, "chunk": number, "n_ids": held, "doc_ids": docs, "lengths": [len(x) // 4 for x in ids],
                   "block": block, "planes": to_planes(b"".join(ids), block)}
            return pa.RecordBatch.from_pylist([row], schema)

        for batch in batches:
            encoder = encoder or shared_encoder(tokenizer_path, end_id)
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                for doc, x in zip(part.column(0).to_pylist(), encoder.encode(part.column(1).to_pylist())):
                    ids.append(x)
                    docs.append(doc)
                    held += len(x) // 4
                    if held >= chunk_ids:
                        yield chunk()
                        ids, docs, held, number = [], [], 0, number + 1
        if docs:
            yield chunk()
    return run


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text",
                 end_id: int = 0, block: int = BLOCK, chunk_ids: int = CHUNK) -> str:
    """Encode all texts and write the chunks to ``path`` in ascending id order."""
    rows = docs.select(quoted(id_col).cast("long").alias("id"), whole(quoted(text_col)).alias("text"))
    tie = F.xxhash64("text")
    ranged = rows.repartitionByRange(F.col("id").asc_nulls_first(), tie).sortWithinPartitions(
        F.col("id").asc_nulls_first(), tie)
    ranged.mapInArrow(_writer(tokenizer_path, end_id, block, chunk_ids), SCHEMA).write.parquet(path)
    return path


def index(spark: SparkSession, path: str) -> DataFrame:
    """(shard, chunk, n_ids, start): the place of each chunk's first id.  Shards are summed
    first, so a window holds the chunks of one shard, or one row per shard."""
    chunks = spark.read.schema(SCHEMA).parquet(path).select("shard", "chunk", "n_ids")
    shards = chunks.groupBy("shard").agg(F.sum("n_ids").alias("ids"))
    shards = shards.select("shard", (F.sum("ids").over(Window.orderBy("shard")) - F.col("ids")).alias("before"))
    inside = F.sum("n_ids").over(Window.partitionBy("shard").orderBy("chunk")) - F.col("n_ids")
    return (chunks.withColumn("inside", inside).join(shards, "shard")
            .select("shard", "chunk", "n_ids", (F.col("before") + F.col("inside")).alias("start")))


def _reader(checksums: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                data, lengths = memoryview(from_planes(row["planes"])), np.array(row["lengths"], np.int64)
                starts = np.cumsum(lengths) - lengths
                parts = [data[4 * a:4 * b] for a, b in zip(starts.tolist(), (starts + lengths).tolist())]
                last = (pa.array([zlib.crc32(p) for p in parts], pa.int64()) if checksums
                        else pa.array([bytes(p) for p in parts], pa.binary()))
                n = len(parts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["shard"]] * n, pa.int32()), pa.array([row["chunk"]] * n, pa.int32()),
                     pa.array(row["doc_ids"], pa.int64()), pa.array(starts), pa.array(lengths), last],
                    ["shard", "chunk", "doc_id", "at", "n_tokens", "ids_crc32" if checksums else "ids"])
    return run


def read_tokens(spark: SparkSession, path: str, *, checksums: bool = False) -> DataFrame:
    """(shard, chunk, doc_id, at, n_tokens, ids): the ids of every document, as bytes; with
    ``checksums`` their crc32 (``ids_crc32``) instead."""
    stored = spark.read.schema(SCHEMA).parquet(path)
    last = "ids_crc32 long" if checksums else "ids binary"
    return stored.select("shard", "chunk", "doc_ids", "lengths", "planes").mapInArrow(
        _reader(checksums), f"shard int, chunk int, doc_id long, at long, n_tokens long, {last}")


def token_report(docs: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    """Write the files and read them back: (doc_id, start, n_tokens, ids_crc32, shard, chunk)."""
    spark = docs.sparkSession
    path = write_tokens(docs, scratch_path(spark, "tokens"), tokenizer_path, **options)
    rows = read_tokens(spark, path, checksums=True)
    starts = index(spark, path).select("shard", "chunk", "start")
    return rows.join(starts, ["shard", "chunk"]).select(
        "doc_id", (F.col("start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "shard", "chunk")
