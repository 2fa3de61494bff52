"""Packages: exact round trip of payloads, revisits, ZIP64 and broken directories."""

import base64
import hashlib
import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from quarry.llm import warc as W
from quarry.llm.zip_archive import ZipDirectory
from quarry.session import scratch_path


class Bytes(io.BytesIO):
    def size(self):
        return len(self.getbuffer())


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def brute(rows, min_bytes=0):
    first = {}
    for i, _, html in rows:
        if i is not None and len((html or "").encode()) >= min_bytes:
            first[html or ""] = min(i, first.get(html or "", i))
    out = []
    for i, url, html in rows:
        f = first.get(html or "")
        revisit = f is not None and f != i
        out.append((i, url or None, "revisit" if revisit else "response", len((html or "").encode()), digest(html), f if revisit else None,
                    None if revisit else (html or "").encode()))
    return sorted(out, key=repr)


def round_trip(spark, rows, **options):
    df = spark.createDataFrame([(*r, "z", 3) for r in rows], "page_id long, url string, html string, sha1 string, first int")
    packages = W.write_packages(df, scratch_path(spark, "test-warc"), **options)
    got = W.read_records(W.read_index(packages), W.tasks_for(packages), payloads=True).collect()
    def as_id(v):
        return None if v is None else int(v)
    return packages, sorted(((as_id(r.id), r.url, r.record_type, r.payload_bytes, r.payload_digest, as_id(r.refers_to),
                              None if r.payload is None else bytes(r.payload)) for r in got), key=repr)


ROWS = [(5, "http://a.b/c?d=é f", "<p>same</p>"), (2, "http://x", "<p>same</p>"), (9, None, "<p>same</p>"), (None, "http://n", "<p>same</p>"),
        (7, "http://e", None), (8, "http://e2", ""), (None, None, "alone"), (None, "u\r\nInjected: 1\r\n\r\n", "alone"),
        (11, "http://k/%41%", "WARC/1.1\r\n\r\nnested\r\n\r\n"), (12, "http://l", "é\u0000\r\n" * 9), (13, "http://m", "long " * 400_000),
        (14, "", "tie"), (14, "", "tie"), (15, "z z", "tie")]


@pytest.mark.parametrize("options", [{}, {"min_bytes": 5}, {"package_bytes": 1}, {"level": 0}])
def test_round_trip(spark, options):
    packages, got = round_trip(spark, ROWS, **options)
    assert got == brute(ROWS, options.get("min_bytes", 0))
    assert packages.agg(F.sum("n_records")).first()[0] == len(ROWS)
    if options.get("package_bytes") == 1:
        assert packages.count() == len(ROWS)


def test_a_hot_payload_and_many_packages(spark):
    rows = [(k, f"http://h/{k}", "hot" if k % 3 == 0 else f"page {k // 2} " * 20) for k in range(2_000, 0, -1)]
    packages, got = round_trip(spark, rows, package_bytes=20_000)
    assert got == brute(rows)
    assert packages.count() > 8


def test_empty_table(spark):
    packages, got = round_trip(spark, [])
    assert got == [] and packages.count() == 0


def test_packages_are_ordinary_archives(spark, tmp_path):
    packages, _ = round_trip(spark, ROWS)
    name = packages.first().package.removeprefix("file://")
    with zipfile.ZipFile(name) as z:
        assert z.testzip() is None
        assert {i.filename: i.compress_type for i in z.infolist()} == {
            "archive/data.warc.gz": zipfile.ZIP_STORED, "indexes/index.cdxj": zipfile.ZIP_STORED}
        data = io.BytesIO(z.read("archive/data.warc.gz"))
    import gzip
    assert gzip.open(data).read().count(b"WARC-Record-ID: <urn:x-record:") >= 1


def test_a_changed_payload_is_an_error():
    record = W.record_bytes("1", "http://a", b"abc", W.bare_digest(hashlib.sha1(b"abc").digest()), None)
    assert W.parse_record(record)["payload"] == b"abc"
    with pytest.raises(ValueError):
        W.parse_record(record.replace(b"abc", b"abd"))
    with pytest.raises(ValueError):
        W.parse_record(record[:-8])
    with pytest.raises(ValueError):
        W.parse_record(b"HTTP/1.1 200 OK\r\n\r\n")


def archive(members, *, comment=b"", method=zipfile.ZIP_STORED):
    out = Bytes()
    with zipfile.ZipFile(out, "w", method) as z:
        z.comment = comment
        for name, data in members:
            z.writestr(name, data)
    return out


def contents(file):
    z, out = ZipDirectory(file), {}
    for m in z.members():
        file.seek(z.data_start(m))
        out[m.name] = file.read(m.size)
        assert list(z.lines(m)) == (out[m.name].split(b"\n")[:-1] if out[m.name].endswith(b"\n") or not out[m.name] else out[m.name].split(b"\n"))
    return out


MEMBERS = [("a/one.txt", b"one\ntwo\n"), ("é.bin", bytes(range(256))), ("empty", b""), ("big", b"x" * 3_000_000 + b"\nlast")]


@pytest.mark.parametrize("comment", [b"", b"plain", b"PK\x05\x06" + b"\0" * 30, b"c" * 65_535])
@pytest.mark.parametrize("before", [b"", b"#!/bin/sh\n" * 50])
def test_directories(comment, before):
    file = Bytes(before + archive(MEMBERS, comment=comment).getvalue())
    assert contents(file) == dict(MEMBERS)


def test_zip64(monkeypatch):
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 100)  # sizes, places and the end record go to ZIP64 fields
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 2)
    out = archive(MEMBERS)
    assert b"PK\x06\x06" in out.getvalue() and b"PK\x06\x07" in out.getvalue()
    assert contents(out) == dict(MEMBERS)
    assert contents(Bytes(b"prefix" * 9 + out.getvalue())) == dict(MEMBERS)


def test_many_members():
    names = [(f"m{k}", b"%d" % k) for k in range(70_000)]
    file = archive(names)
    z = ZipDirectory(file)
    found = list(z.members())
    assert len(found) == 70_000 and z.entries == 70_000
    for k in random.Random(1).sample(range(70_000), 50):
        file.seek(z.data_start(found[k]))
        assert file.read(found[k].size) == b"%d" % k


def test_what_cannot_be_range_read():
    packed = archive([("a", b"x" * 99)], method=zipfile.ZIP_DEFLATED)
    z = ZipDirectory(packed)
    with pytest.raises(ValueError):
        z.data_start(next(z.members()))
    for bad in (b"", b"PK", b"no archive at all" * 9, archive(MEMBERS).getvalue()[:-5], archive(MEMBERS).getvalue()[3_000_000:]):
        with pytest.raises(ValueError):
            contents(Bytes(bad))


def test_empty_archive():
    assert contents(archive([])) == {}


def test_arrow_store_paths(tmp_path):
    from quarry.llm.zip_archive import open_store
    (tmp_path / "f").write_bytes(b"abc")
    for uri in (f"{tmp_path}/f", f"file:{tmp_path}/f", f"file://{tmp_path}/f"):
        store, place = open_store(uri)
        with store.open_input_file(place) as file:
            assert file.size() == 3
