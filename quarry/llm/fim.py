"""Fill-in-the-middle: texts cut at two ranks and written prefix, suffix, middle.

A text is a sequence of units (lines, words or characters).  Its units form an indexable
skip list: lane 0 links every unit to the next, every express lane keeps about one node in
``FAN`` of the lane below, and each link carries the width it spans in units, in code points
and in bytes.  A cut rank is reached from the top lane down: a link is taken while the units
passed so far and its own do not exceed the rank, and the code points passed are the cut.
Which nodes rise is a hash of their place, so a rerun builds the same list.

Forms, with the marks ``<P>``, ``<S>`` and ``<M>``:

    plain   the text itself
    psm     <P>prefix<S>suffix<M>middle
    spm     <S>suffix<P>prefix<M>middle

The two ranks, whether a text is cut at all and its form come from the SHA-256 of
``seed:id``, never from a random state, so reruns and retries agree.  ``restored`` rebuilds
the text from output and form alone: marks occur in no text that is cut.

Scale: one pass, no shuffle; a task holds one Arrow batch and the list of one text.

Defined cases: NULL and empty texts are plain, with no units; a text that holds a mark is
plain; equal ranks give an empty middle; a NULL id hashes as the empty id; repeated rows get
equal results; a very long text is one row's work, in memory proportional to it; an empty
table gives no rows; other columns of the table are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import quoted, whole

SEED, RATE, SPM_RATE, FAN_BITS = 7, 100, 50, 2
MARKS = ("<P>", "<S>", "<M>")


def checked_marks(marks: tuple[str, str, str]) -> tuple[str, str, str]:
    """Three marks that can be found again in any output: each starts with one character
    that no mark holds anywhere else, so no mark can begin inside a piece or another mark."""
    first = marks[0][:1]
    if len(set(marks)) != 3 or not first or any(m[:1] != first or first in m[1:] for m in marks):
        raise ValueError("marks must differ and share a first character that they hold nowhere else")
    if any(a != b and a.startswith(b) for a in marks for b in marks):
        raise ValueError("no mark may begin with another")
    return marks


def unit_ends(data: np.ndarray, unit: str) -> np.ndarray:
    """Byte places where units end.  ``line``: after each line feed, and at the end;
    ``char``: after each code point; ``word``: before each word but the first, so white
    space goes with the word before it (leading white space with the first)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    if unit == "line":
        inner = np.flatnonzero(data[:-1] == 10) + 1
    elif unit == "char":
        inner = np.flatnonzero((data[1:] & 0xC0) != 0x80) + 1
    elif unit == "word":
        blank = (data == 32) | ((data >= 9) & (data <= 13))
        inner = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
        inner = inner[1:] if blank[0] else inner
    else:
        raise ValueError(f"unit {unit!r}")
    return np.append(inner, n)


class SkipList:
    """Units of one text with their widths: ``lanes[k]`` is (widths, down), a row of widths
    (units, code points, bytes) per link and the place of each node in the lane below."""

    def __init__(self, widths: np.ndarray):
        self.n = len(widths)
        lane = np.column_stack([np.ones(self.n, np.int64), widths])
        rank = np.arange(self.n, dtype=np.uint64)
        # a node's tower is as high as its hashed place has leading pairs of zero bits
        rise = (rank + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        rise ^= rise >> np.uint64(29)
        rise *= np.uint64(0xBF58476D1CE4E5B9)
        rise ^= rise >> np.uint64(32)
        self.lanes = [(lane, None)]
        while len(lane) > 1:
            kept = (rise & np.uint64(2 ** FAN_BITS - 1)) == 0
            kept[0] = True  # the head stands in every lane
            down = np.flatnonzero(kept)
            if len(down) == len(lane):
                rise = rise >> np.uint64(FAN_BITS)
                if not rise.any():
                    break
                continue
            lane = np.add.reduceat(lane, down)
            rise = rise[down] >> np.uint64(FAN_BITS)
            self.lanes.append((lane, np.append(down, len(kept))))

    def locate(self, rank: int) -> tuple[int, int]:
        """(code points, bytes) of the first ``rank`` units."""
        if not 0 <= rank <= self.n:
            raise IndexError(rank)
        at = units = points = size = 0
        for lane, down in reversed(self.lanes):
            last = len(lane)
            while at < last:
                u, p, b = lane[at].tolist()
                if units + u > rank:
                    break
                units, points, size, at = units + u, points + p, size + b, at + 1
            if down is not None:
                at = int(down[at])
        return points, size


def skip_list(data: np.ndarray, unit: str) -> SkipList:
    """The skip list of a text's UTF-8 bytes."""
    ends = unit_ends(data, unit)
    if not len(ends):
        return SkipList(np.zeros((0, 2), np.int64))
    starts = np.append(0, ends[:-1])
    points = np.add.reduceat(((data & 0xC0) != 0x80).astype(np.int64), starts)
    return SkipList(np.column_stack([points, ends - starts]))


def draws(seed: int, key: str) -> tuple[int, int, int, int]:
    """Four unsigned integers: the first 8-digit groups of the hex SHA-256 of ``seed:key``."""
    digest = hashlib.sha256(f"{seed}:{key}".encode()).digest()
    return tuple(int.from_bytes(digest[4 * k:4 * k + 4], "big") for k in range(4))


def _cutter(seed: int, unit: str, rate: int, spm_rate: int, marks: tuple[bytes, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2)
            large = pa.types.is_large_string(texts.type)
            _, offsets, data = texts.buffers()
            bounds = np.frombuffer(offsets, np.int64 if large else np.int32)[texts.offset:texts.offset + len(texts) + 1]
            data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
            units, forms, prefix, middle = [], [], [], []
            for key, a, b in zip(batch.column(1).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                text = data[a:b]
                units_of = skip_list(text, unit)
                n, (h1, h2, h3, h4) = units_of.n, draws(seed, key)
                units.append(n)
                raw = text.tobytes()
                if not raw or h3 % 100 >= rate or any(m in raw for m in marks):
                    forms.append("plain")
                    prefix.append(None)
                    middle.append(None)
                    continue
                first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
                start, end = units_of.locate(first)[0], units_of.locate(second)[0]
                forms.append("spm" if h4 % 100 < spm_rate else "psm")
                prefix.append(start)
                middle.append(end - start)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), texts, pa.array(units, pa.int64()), pa.array(forms, pa.string()),
                 pa.array(prefix, pa.int64()), pa.array(middle, pa.int64())],
                ["id", "text", "n", "form", "prefix_chars", "middle_chars"])
    return run


def fill_in_middle(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, unit: str = "line",
                   rate: int = RATE, spm_rate: int = SPM_RATE, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """(id, n, form, prefix, middle, suffix, output): units of every text, its form, the
    three pieces (NULL if plain) and the rearranged text.  ``rate`` per cent of the texts
    are cut, ``spm_rate`` per cent of these in the form spm."""
    p, s, m = checked_marks(marks)
    rows = docs.select(quoted(id_col).alias("id"), F.coalesce(quoted(id_col).cast("string"), F.lit("")).alias("key"),
                       whole(quoted(text_col)).alias("text"))
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType)]
                          + T._parse_datatype_string("text string, n long, form string, prefix_chars long, middle_chars long").fields)
    cut = rows.mapInArrow(_cutter(seed, unit, rate, spm_rate, tuple(x.encode() for x in marks)), schema)
    whole_cut = F.col("form") != "plain"
    start, width = F.col("prefix_chars").cast("int"), F.col("middle_chars").cast("int")
    pieces = cut.select(
        F.col("id").alias(id_col), "n", "form", "text",
        F.when(whole_cut, F.substring("text", F.lit(1), start)).alias("prefix"),
        F.when(whole_cut, F.substring("text", start + 1, width)).alias("middle"),
        F.when(whole_cut, F.substring("text", start + width + 1, F.length("text"))).alias("suffix"))
    output = (F.when(F.col("form") == "psm", F.concat(F.lit(p), "prefix", F.lit(s), "suffix", F.lit(m), "middle"))
              .when(F.col("form") == "spm", F.concat(F.lit(s), "suffix", F.lit(p), "prefix", F.lit(m), "middle"))
              .otherwise(F.col("text")))
    return pieces.select(quoted(id_col), "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output was made of, from the output and its form alone."""
    p, s, m = checked_marks(marks)

    def pieces(opening: str, second: str) -> tuple[Column, Column, Column]:
        head = F.substring_index(output, second, 1)  # opening mark and first piece
        rest = F.substring(output, F.length(head) + len(second) + 1, F.length(output))
        inner = F.substring_index(rest, m, 1)
        return (F.substring(head, F.lit(len(opening) + 1), F.length(head)), inner,
                F.substring(rest, F.length(inner) + len(m) + 1, F.length(rest)))

    prefix, suffix, middle = pieces(p, s)
    suffix2, prefix2, middle2 = pieces(s, p)
    return (F.when(form == "psm", F.concat(prefix, middle, suffix))
            .when(form == "spm", F.concat(prefix2, middle2, suffix2)).otherwise(output))
