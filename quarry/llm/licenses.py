"""Licence scan: sparse TF-IDF cosine of lines, windows and whole texts to licence
templates, then inheritance from the nearest ancestor directory.

Terms are weighted by count times inverse document frequency over all texts.  A template
of up to ``NOTICE_TERMS`` terms is a notice, a longer one the text of a licence.  A part of
a text names the licence of its most similar template:

* Lines are compared with notices (cosine at least ``threshold``).  A line can reach that
  only if it holds one of a notice's heaviest terms, those without which less than
  ``threshold``^2 of its squared norm is left.  This test runs inside the row; only lines
  that pass are exploded to terms.
* A text without a licensed line is read in windows of a notice's length, across lines,
  that lay one of the notice's heaviest terms where the notice has it; so a notice inside a
  long line, or wrapped over lines, is found.  A window has no terms beside the notice and
  is the best of many, so it must be nearer than a line (``window_threshold``).
* Whole texts are compared with licence texts (``file_threshold``).  A text can reach that
  only if its terms hold ``file_threshold``^2 of the licence text's squared norm; only such
  texts are exploded.  Where a whole text matches, its lines do not count.
* A text that is mostly a licence (it matches as a whole, or ``file_share`` of its terms lie
  in licensed lines or in its best window) is a licence file and speaks for its directory.
  Files without a licence of their own inherit from the nearest directory above (their own
  first) that has a licence file: distinct directories are joined with their ancestors'
  paths, then files with their directory.  Of several licence files in a directory the most
  similar counts, ties by name.

Scale: everything is DataFrame operations.  Template terms are few (the template table is a
parameter of the user and is checked against ``MAX_TEMPLATES``).  Texts are scanned for
the template terms they hold, for candidates, and for the frequencies of the candidates'
terms; only candidates' terms are shuffled, never texts (windows of more than ``FEW`` places
are cut after a join by text).

Defined cases: NULL and empty texts have no licence of their own; a NULL path is in no
directory and neither inherits nor speaks; repeated rows are reported alike; a template
without terms matches nothing; empty tables give no rows.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import quoted, stored, whole

THRESHOLD, FILE_SHARE, MAX_TEMPLATES = 0.6, 0.4, 10_000
#: Least cosine of a window and of a whole text, most terms of a notice, and rows that are still broadcast.
WINDOW_THRESHOLD, FILE_THRESHOLD, NOTICE_TERMS, FEW = 0.8, 0.85, 60, 1_000_000
#: Whole licence texts, one file per licence.
TEXTS = Path(__file__).parent / "license_texts"

# Names and opening sentences of common public licences.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except "
                   "in compliance with the License"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are "
                     "permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "This work is licensed under the Creative Commons Attribution 4.0 International License"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International "
                     "License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0"),
]


def standard_templates(spark: SparkSession) -> DataFrame:
    texts = [(p.stem, p.read_text("utf-8")) for p in sorted(TEXTS.glob("*.txt"))]
    return spark.createDataFrame(TEMPLATES + texts, "license string, text string")


def terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _idf(df: Column, n: int) -> Column:
    return F.log((F.lit(float(n)) + 1) / (df + 1)) + 1


def licensed_parts(files: DataFrame, templates: DataFrame, *, text_col: str = "text", threshold: float = THRESHOLD,
                   window_threshold: float = WINDOW_THRESHOLD, file_threshold: float = FILE_THRESHOLD) -> DataFrame:
    """(key, kind, unit, license, similarity, n_terms) of every licensed ``line``, ``window`` and
    ``file``; ``key`` is the hash of the text, so a text that many files share is looked at in
    shared partial sums."""
    text = whole(quoted(text_col))
    texts = files.select(F.xxhash64(text).alias("key"), text.alias("text"))
    n = texts.count()
    known = stored(templates.select("license", terms(whole("text")).alias("terms")).where(F.size("terms") > 0)
                   .distinct().withColumns({"template": F.xxhash64("license", "terms"),
                                            "full": F.size("terms") > NOTICE_TERMS}), "license-templates")
    n_templates = known.count()
    if n_templates > MAX_TEMPLATES:
        raise ValueError(f"at most {MAX_TEMPLATES} templates are supported")
    if not n or not n_templates:
        return files.sparkSession.createDataFrame(
            [], "key long, kind string, unit long, license string, similarity double, n_terms int")

    def few(rows: DataFrame) -> DataFrame:
        return F.broadcast(rows) if rows.count() <= FEW else rows

    def held(wanted: DataFrame) -> DataFrame:
        """(key, term) of the terms ``wanted`` that each text holds."""
        return texts.select("key", F.explode(F.array_distinct(terms(F.col("text")))).alias("term")).join(few(wanted), "term")

    def frequencies(wanted: DataFrame, spots: DataFrame) -> DataFrame:
        """(term, df) over all texts for the terms ``wanted``."""
        return wanted.join(spots.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "term", "left").fillna(0, ["df"])

    # weights of the templates' terms, and the heaviest of each notice
    own = known.select("template", "full", F.explode("terms").alias("term")).groupBy("template", "full", "term").agg(
        F.count(F.lit(1)).alias("tf"))
    wanted = stored(own.select("term").distinct(), "license-words")
    spots = stored(held(wanted).select("key", "term"), "license-spots")
    own = own.join(frequencies(wanted, spots), "term").withColumn("weight", F.col("tf") * _idf(F.col("df"), n))
    own = stored(own, "license-weights")
    norm = own.groupBy("template").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("size"))
    y = stored(own.join(norm, "template").select("template", "full", "term", (F.col("weight") / F.col("size")).alias("y")),
               "license-units")
    heavy = []
    by_template: dict[int, list] = {}
    for r in own.where("NOT full").collect():  # at most MAX_TEMPLATES short texts
        by_template.setdefault(r["template"], []).append((r["weight"] ** 2, r["term"]))
    for template, rows in by_template.items():
        left = total = sum(w for w, _ in rows)
        for w, term in sorted(rows, reverse=True):
            if left < threshold ** 2 * total - 1e-9:
                break
            heavy.append((template, term))
            left -= w

    def similar(units: DataFrame, least: float, name: str) -> DataFrame:
        """The best template of each unit (key, unit, kind, full, terms), of at least ``least`` for notices."""
        counted = units.select("key", "unit", "full", F.explode("terms").alias("term")).groupBy(
            "key", "unit", "full", "term").agg(F.count(F.lit(1)).alias("tf"))
        wanted = stored(counted.select("term").distinct(), f"license-{name}-terms")
        df = stored(frequencies(wanted, held(wanted)), f"license-{name}-df")
        x = counted.join(df, "term").withColumn("x", F.col("tf") * _idf(F.col("df"), n))
        norms = x.groupBy("key", "unit").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
        dots = (x.join(F.broadcast(y), ["term", "full"]).groupBy("key", "unit", "template")
                .agg(F.sum(F.col("x") * F.col("y")).alias("dot")))
        near = (dots.join(norms, ["key", "unit"]).withColumn("similarity", F.round(F.col("dot") / F.col("norm"), 9))
                .join(F.broadcast(known.select("template", "license", "full")), "template")
                .where(F.col("similarity") >= F.when(F.col("full"), file_threshold).otherwise(least)))
        best = near.groupBy("key", "unit").agg(F.max_by("license", F.struct(
            "similarity", (-F.length("license")).alias("short"), "license")).alias("license"),
            F.max("similarity").alias("similarity"))
        return stored(best.join(units.select("key", "unit", "kind", F.size("terms").alias("n_terms")), ["key", "unit"])
                      .select("key", "kind", "unit", "license", "similarity", "n_terms"), f"license-{name}")

    def units_of(rows: DataFrame, kind: str, full: bool, name: str) -> DataFrame:
        """(key, unit, terms), each distinct text's units once."""
        rows = rows.groupBy("key", "unit").agg(F.first("terms").alias("terms"))
        return stored(rows.withColumns({"kind": F.lit(kind), "full": F.lit(full)}), f"license-{name}")

    # candidate lines
    keys = F.array(*[F.lit(t) for t in sorted({t for _, t in heavy})]).cast("array<string>")
    lines = F.filter(F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(i.cast("long").alias("unit"), terms(x).alias("terms"))),
                     lambda x: F.arrays_overlap(x["terms"], keys))
    found = texts.select("key", F.explode(lines).alias("l")).select("key", "l.unit", "l.terms")
    near_lines = similar(units_of(found, "line", False, "line-units"), threshold, "lines")
    # candidate windows of the other texts
    anchors = files.sparkSession.createDataFrame(heavy, "template long, term string").join(
        known.where("NOT full"), "template").select(
            "template", "term", (F.array_position("terms", F.col("term")) - 1).alias("at"), F.size("terms").alias("length"))
    places = (texts.select("key", F.posexplode(terms(F.col("text"))).alias("pos", "term")).join(F.broadcast(anchors), "term")
              .select("key", "template", "length", F.greatest(F.col("pos") - F.col("at"), F.lit(0)).cast("int").alias("start"))
              .join(near_lines.select("key").distinct(), "key", "left_anti").distinct())
    places = stored(places.groupBy("key").agg(F.collect_list(F.struct("template", "start", "length")).alias("places")),
                    "license-places")
    many = places.agg(F.coalesce(F.sum(F.size("places")), F.lit(0))).first()[0]
    cut = texts.join(F.broadcast(places) if many <= FEW else places, "key").select(
        "key", terms(F.col("text")).alias("terms"), "places")
    cut = cut.select("key", F.explode(F.transform("places", lambda p: F.struct(
        p["template"].alias("template"), F.xxhash64(p["start"], p["length"]).alias("unit"),
        F.slice("terms", p["start"] + 1, p["length"]).alias("terms")))).alias("w")).select("key", "w.*")
    shares = y.where("NOT full").groupBy("template").agg(F.map_from_entries(F.collect_list(
        F.struct("term", (F.col("y") * F.col("y")).alias("share")))).alias("shares"))
    share = F.aggregate(F.array_distinct("terms"), F.lit(0.0), lambda s, t: s + F.coalesce(F.col("shares")[t], F.lit(0.0)))
    windows = cut.join(F.broadcast(shares), "template").where(share >= window_threshold ** 2 - 1e-9)
    # candidate files
    whole_texts = (spots.join(F.broadcast(y.where("full")), "term").groupBy("key", "template")
                   .agg(F.sum(F.col("y") * F.col("y")).alias("share")).where(F.col("share") >= file_threshold ** 2 - 1e-9))
    whole_texts = stored(whole_texts.select("key").distinct(), "license-whole")
    whole_texts = texts.join(few(whole_texts), "key").select("key", F.lit(-1).cast("long").alias("unit"),
                                                            terms(F.col("text")).alias("terms"))
    others = units_of(windows, "window", False, "window-units").unionByName(
        units_of(whole_texts, "file", True, "file-units"))
    return near_lines.unionByName(similar(others, window_threshold, "others"))


def _ancestors(folder: Column) -> Column:
    """The folder and those above it, deepest first: a/b/c -> [a/b/c, a/b, a]."""
    parts = F.split(folder, "/")
    return F.transform(F.sequence(F.size(parts), F.lit(1)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))


def licenses(files: DataFrame, templates: DataFrame | None = None, *, id_col: str = "doc_id", path_col: str = "path",
             text_col: str = "text", threshold: float = THRESHOLD, file_share: float = FILE_SHARE,
             window_threshold: float = WINDOW_THRESHOLD, file_threshold: float = FILE_THRESHOLD) -> DataFrame:
    """One row per file: (doc_id, path, license, similarity, origin, source_dir); ``origin`` is
    ``own``, ``inherited`` or NULL."""
    spark = files.sparkSession
    templates = standard_templates(spark) if templates is None else templates
    parts = licensed_parts(files, templates, text_col=text_col, threshold=threshold,
                           window_threshold=window_threshold, file_threshold=file_threshold)
    kind = F.col("kind")
    first = F.struct(kind == "file", "similarity", "license")
    own = parts.groupBy("key").agg(
        F.max_by("license", first).alias("license"), F.max_by("similarity", first).alias("similarity"),
        F.greatest(F.sum(F.when(kind == "line", F.col("n_terms"))), F.max(F.when(kind != "line", F.col("n_terms"))))
        .alias("covered"))
    text, path = whole(quoted(text_col)), quoted(path_col).cast("string")
    folder = F.when(F.instr(path, "/") > 0, F.regexp_extract(path, "^(.*)/[^/]*$", 1)).when(path.isNotNull(), "")
    rows = files.select(quoted(id_col).alias("doc_id"), path.alias("path"), folder.alias("folder"),
                        F.xxhash64(text).alias("key"), F.size(terms(text)).alias("n_terms"))
    rows = stored(rows.join(own, "key", "left"), "license-files")
    speaks = rows.where((F.col("covered") >= file_share * F.col("n_terms")) & F.col("folder").isNotNull())
    folders = speaks.groupBy("folder").agg(
        F.max_by("license", F.struct("similarity", "license")).alias("dir_license"),
        F.max("similarity").alias("dir_similarity")).withColumnRenamed("folder", "dir")
    above = rows.where("folder is not null").select("folder").distinct().select(
        "folder", F.posexplode(_ancestors(F.col("folder"))).alias("up", "dir"))
    nearest = above.join(folders, "dir").groupBy("folder").agg(
        F.min(F.struct("up", "dir", "dir_license", "dir_similarity")).alias("d"))
    nearest = stored(nearest.select(F.col("folder").alias("f"), "d.dir", "d.dir_license", "d.dir_similarity"),
                     "license-folders")
    rows = rows.join(nearest, rows["folder"] == nearest["f"], "left")
    mine = F.col("license").isNotNull()
    return rows.select(
        "doc_id", "path", F.coalesce("license", "dir_license").alias("license"),
        F.when(mine, F.col("similarity")).otherwise(F.col("dir_similarity")).alias("similarity"),
        F.when(mine, F.lit("own")).when(F.col("dir_license").isNotNull(), F.lit("inherited")).alias("origin"),
        F.when(~mine, F.col("dir")).alias("source_dir"))
