"""Scalar Column builders on literal fixtures."""


from quarry.functions.mime import file_suffix, mime_from_name, is_supported
from quarry.functions.tags import tags_filter
from quarry.functions.text import clean_text, normalize_index_name, normalize_table_prefix, strip_nul
from quarry.functions.vectors import cosine_distance


def one(spark, col, data, schema="x string"):
    return [r[0] for r in spark.createDataFrame(data, schema).select(col).collect()]


def test_clean_text(spark):
    assert one(spark, clean_text("x"), [(" a \r\nb\n\n\n c\rd \n",)]) == ["a b\nc d"]
    assert one(spark, clean_text("x"), [(None,), ("   ",)]) == ["", ""]


def test_index_names(spark):
    assert one(spark, normalize_index_name("x"), [(" My_Index.v1/x:y|z\\w ",)]) == ["my-index-v1-x-y-z-w"]
    assert one(spark, normalize_index_name("x"), [("   ",)]) == [None]
    assert one(spark, normalize_table_prefix("x"), [(None,)]) == [""]


def test_strip_nul(spark):
    assert one(spark, strip_nul("x"), [("a\u0000b",)]) == ["ab"]


def test_tag_filter(spark):
    rows = [("1", ["type:news", "lang:fr"]), ("2", ["type:news"]), ("3", ["__document_id:doc4"]),
            ("4", [])]
    df = spark.createDataFrame(rows, "id string, tags array<string>")
    f = [["type:news", "lang:fr"], ["__document_id:doc4"]]
    assert sorted(r.id for r in df.where(tags_filter(f)).collect()) == ["1", "3"]
    assert df.where(tags_filter([])).count() == 4
    assert df.where(tags_filter([[], []])).count() == 4
    assert sorted(r.id for r in df.where(tags_filter([{"type": "news"}])).collect()) == ["1", "2"]


def test_mime(spark):
    names = [("a/b/report.PDF",), ("x.tar.gz",), (".bashrc",), ("noext",), ("page.html?x=1",), ("a.txt",)]
    out = spark.createDataFrame(names, "x string").select(
        file_suffix("x").alias("s"), mime_from_name("x").alias("m"),
        is_supported(mime_from_name("x")).alias("ok")).collect()
    assert [r.s for r in out] == [".pdf", ".gz", "", "", ".html", ".txt"]
    assert [r.m for r in out] == ["application/pdf", "application/gzip", None, None, "text/html", "text/plain"]
    assert [r.ok for r in out] == [True, False, False, False, False, True]


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0]), ([1.0, 1.0], [2.0, 2.0])],
                               "a array<double>, b array<double>")
    d = [round(r[0], 9) for r in df.select(cosine_distance("a", "b")).collect()]
    assert d == [1.0, 0.0]


def test_mime_strict(spark):
    import pytest
    from quarry.functions.mime import mime_from_name_strict
    ok = spark.createDataFrame([("a.docx",)], "x string").select(mime_from_name_strict("x")).first()[0]
    assert ok.endswith("wordprocessingml.document")
    with pytest.raises(Exception, match="File type not supported"):
        spark.createDataFrame([("a.xyz",)], "x string").select(mime_from_name_strict("x")).collect()
