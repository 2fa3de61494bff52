"""Fill-in-the-middle: cuts against regular expressions, exact restoration, edges."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import fim as M

UNITS = {"line": r"[^\n]*\n|[^\n]+", "char": r"[\s\S]", "word": r"\A[ \t\n\v\f\r]*[^ \t\n\v\f\r]*[ \t\n\v\f\r]*|[^ \t\n\v\f\r]+[ \t\n\v\f\r]*"}


def brute(doc_id, text, unit="line", seed=7, rate=100, spm=50, marks=M.MARKS):
    text = text or ""
    units = [u for u in re.findall(UNITS[unit], text) if u]
    assert "".join(units) == text
    hexed = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(hexed[8 * k:8 * k + 8], 16) for k in range(4))
    n = len(units)
    if not text or any(m in text for m in marks) or h3 % 100 >= rate:
        return n, "plain", None, None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < spm:
        return n, "spm", p, m, s, f"{marks[1]}{s}{marks[0]}{p}{marks[2]}{m}"
    return n, "psm", p, m, s, f"{marks[0]}{p}{marks[1]}{s}{marks[2]}{m}"


TEXTS = [None, "", "\n", "\n\n\n", "one line", "a\nb", "a\nb\n", "\na", "é\nüß\n日本語\n😀 x\n", "has <P> in\nit", "<S>", "x<M>", "< P>\n<\n<S\nP>",
         "<\n" * 9, "\r\n\r\ntail", "  lead word  tail ", "a\x00b\nc\x85d e", "long\n" * 50_000, "w " * 20_000, "ü" * 70_000]


@pytest.mark.parametrize("unit", ["line", "word", "char"])
def test_lists_reach_every_rank(unit):
    rng = random.Random(3)
    for n in [0, 1, 2, 3, 5, 17, 200]:
        text = "".join(rng.choice(["a", "é", "日", "😀", "\n", " "]) for _ in range(n))
        units = [u for u in re.findall(UNITS[unit], text) if u]
        made = M.skip_list(np.frombuffer(text.encode(), np.uint8), unit)
        assert made.n == len(units)
        for r in range(len(units) + 1):
            before = "".join(units[:r])
            assert made.locate(r) == (len(before), len(before.encode()))
        with pytest.raises(IndexError):
            made.locate(len(units) + 1)


def test_lanes_thin_out_and_keep_widths():
    made = M.SkipList(np.ones((100_000, 2), np.int64))
    sizes = [len(lane) for lane, _ in made.lanes]
    assert len(sizes) > 6 and sizes[0] == 100_000 and sizes[-1] < 20
    assert all(2 * b < a for a, b in zip(sizes, sizes[1:]) if a > 500)
    assert all(lane.sum(axis=0).tolist() == [100_000] * 3 for lane, _ in made.lanes)


@pytest.mark.parametrize("options", [{}, {"unit": "char", "seed": 11}, {"unit": "word", "spm_rate": 0}, {"rate": 30, "spm_rate": 100}])
def test_equals_brute_force(spark, options):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(None, "null\nid\n"), (3, "again\n"), (3, "again\n")]
    df = spark.createDataFrame([(*r, "x", 5) for r in rows], "doc_id long, text string, form string, prefix int")
    names = {"spm_rate": "spm"}
    got = M.fill_in_middle(df, **options).withColumn("back", M.restored(F.col("output"), F.col("form"))).collect()
    want = [(i, *brute(i, t, **{names.get(k, k): v for k, v in options.items()}), t or "") for i, t in rows]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_other_names_and_marks(spark):
    marks = ("\u0001PRE", "\u0001SUF", "\u0001MID")
    df = spark.createDataFrame([("k.1", "a\nb\n<P>c\n")], "`my id` string, `my.text` string")
    got = M.fill_in_middle(df, id_col="my id", text_col="my.text", marks=marks).first()
    n, form, p, m, s, out = brute("k.1", "a\nb\n<P>c\n", marks=marks)
    assert (got["my id"], got.n, got.form, got.prefix, got.middle, got.suffix, got.output) == ("k.1", n, form, p, m, s, out)
    assert M.fill_in_middle(df.limit(0), id_col="my id", text_col="my.text").collect() == []
    for bad in (("<P>", "<S>", "<P>"), ("<P>", "[S]", "<M>"), ("<P<", "<S>", "<M>"), ("<P", "<P>", "<M>")):
        with pytest.raises(ValueError):
            M.fill_in_middle(df, id_col="my id", text_col="my.text", marks=bad)
