"""Licence scan against a brute-force cosine, and inheritance along paths."""

import math
import re
import textwrap
from collections import Counter

from quarry.llm import licenses as L


def terms(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def brute_own(files, templates, threshold):
    n = len(files)
    df = Counter(x for _, _, t in files for x in set(terms(t)))
    idf = lambda w: math.log((n + 1) / (df[w] + 1)) + 1

    def cosine(a, b):
        a, b = Counter(a), Counter(b)
        dot = sum(a[w] * b[w] * idf(w) ** 2 for w in a if w in b)
        size = lambda x: math.sqrt(sum((c * idf(w)) ** 2 for w, c in x.items()))
        return dot / (size(a) * size(b)) if a and b else 0.0

    out = {}
    for key, _, text in files:
        best, covered = None, 0
        for line in (text or "").split("\n"):
            found = max(((round(cosine(terms(line), terms(t)), 9), -len(k), k) for k, t in templates), default=(0, 0, ""))
            if found[0] >= threshold:
                covered += len(terms(line))
                best = max(best or (0, ""), (found[0], found[2]))
        out[key] = (best, covered, len(terms(text)))
    return out


def brute(files, templates, threshold=L.THRESHOLD, share=L.FILE_SHARE):
    own = brute_own(files, templates, threshold)
    folder = lambda p: None if p is None else p.rsplit("/", 1)[0] if "/" in p else ""
    speaks = {}
    for key, path, _ in files:
        best, covered, n = own[key]
        if best and covered >= share * n and path is not None:
            speaks[folder(path)] = max(speaks.get(folder(path), best), best)
    out = {}
    for key, path, _ in files:
        best, at = own[key][0], folder(path)
        origin = "own" if best else None
        while best is None and at is not None:
            if at in speaks:
                best, origin = speaks[at], "inherited"
            at = at.rsplit("/", 1)[0] if "/" in at else None
        out[key] = (best[1], round(best[0], 6), origin) if best else (None, None, None)
    return out


def check(spark, files, templates=None):
    df = spark.createDataFrame([(*f, "x") for f in files], "doc_id long, path string, text string, license string")
    t = spark.createDataFrame(templates, "license string, text string") if templates is not None else None
    got = {r.doc_id: (r.license, r.similarity and round(r.similarity, 6), r.origin) for r in L.licenses(df, t).collect()}
    assert got == brute(files, L.TEMPLATES if templates is None else templates)
    return got


def test_headers_files_and_inheritance(spark):
    prose = "some words that have nothing to do with it\nand another line of the text"
    files = [
        (1, "a/LICENSE", "Released under the MIT License."),
        (2, "a/b/x.txt", prose), (3, "a/b/c/y.txt", prose + "\nLicensed under the Apache License, Version 2.0.\n" + prose),
        (4, "a/b/c/COPYING", "This work is licensed under the GNU General Public License, version 3.\n"),
        (5, "a/b/c/d/e/z.txt", "other prose"), (6, "q/z.txt", "other prose, far away"), (7, "top.txt", prose),
        (8, None, "Released under the MIT License."), (9, None, prose), (10, "a/n.txt", None), (11, "a/b/e.txt", ""),
        (12, "q/r/l.txt", "LICENSED UNDER CC BY-NC 4.0!"), (13, "q/r/s.txt", "Released under MIT"),
        (14, "q/long.txt", (prose + "\n") * 3000 + "Released under the MIT License."),
        (15, "a/b/c/q.txt", "the license of the software is under the version of the general public work"),
        (16, "/abs/x.txt", prose), (17, "/abs/LICENSE", "Licensed under CC BY 4.0"),
    ]
    got = check(spark, files)
    assert got[2] == ("MIT", got[1][1], "inherited") and got[5][0] == "GPL-3.0" and got[3][0] == "Apache-2.0"
    assert got[6][0] is None and got[10][2] == "inherited" and got[12][0] == "CC-BY-NC-4.0"
    assert got[14][2] == "own" and got[16][0] == "CC-BY-4.0"


def test_other_templates_and_repeated_rows(spark):
    files = [(k, f"d{k % 5}/f{k}", f"row {k}\nfree to use by all who ask") for k in range(40)]
    files += [(100, "d1/l", "free to use by all"), (101, "d2/l", "never to be used")]
    check(spark, files, [("F", "free to use by all"), ("N", "never to be used"), ("E", ""), ("X", None)])
    df = spark.createDataFrame([(1, "a/b", "Released under the MIT License.")] * 3, "doc_id long, path string, text string")
    assert [tuple(r)[2:5] for r in L.licenses(df).collect()] == [("MIT", 1.0, "own")] * 3


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, path string, text string")
    assert L.licenses(df).collect() == []
    one = spark.createDataFrame([(1, "a/b", "Released under the MIT License.")], df.schema)
    none = spark.createDataFrame([], "license string, text string")
    assert [r.license for r in L.licenses(one, none).collect()] == [None]


def test_whole_texts_and_notices_in_long_lines(spark):
    texts = {p.stem: p.read_text() for p in L.TEXTS.glob("*.txt")}
    assert set(texts) == {"Apache-2.0", "BSD-3-Clause", "GPL-3.0", "LGPL-3.0", "MIT", "MPL-2.0"}
    wrapped = {k: "\n".join(textwrap.fill(x, 78) for x in t.replace("<year> <copyright holders>", "2021 A. Body").split("\n"))
               for k, t in texts.items()}
    filler = " ".join(f"filler{k}" for k in range(30))
    files = [(k, f"{name}/LICENSE", wrapped[name]) for k, name in enumerate(sorted(texts))]
    files += [(10 + k, f"{name}/src/deep/x.txt", "prose of its own kind") for k, name in enumerate(sorted(texts))]
    files += [(20, "one/x.txt", f"{filler} Released under the MIT License. {filler}"), (21, "one/y.txt", filler),
              (22, "two/x.txt", f"{filler} this program is free\nsoftware: you can redistribute\nit and/or modify it\nunder the "
               f"terms of the\nGNU General Public License as\npublished by the Free\nSoftware Foundation {filler}")]
    df = spark.createDataFrame(files, "doc_id long, path string, text string")
    got = {r.doc_id: r for r in L.licenses(df).collect()}
    for k, name in enumerate(sorted(texts)):
        assert (got[k].license, got[k].origin) == (name, "own") and got[k].similarity > 0.95
        assert (got[10 + k].license, got[10 + k].origin, got[10 + k].source_dir) == (name, "inherited", name)
    assert (got[20].license, got[20].origin) == ("MIT", "own") and got[21].license is None
    assert (got[22].license, got[22].origin) == ("GPL-3.0", "own")
