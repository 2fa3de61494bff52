"""Web archives: WARC records in ZIP packages, written by tasks and read by ranges.

A package is a ZIP archive with two stored members:

    archive/data.warc.gz   one gzip member per WARC record
    indexes/index.cdxj     per record: URL, time, and a JSON object with the record's place
                           (offset, length), digest and file name

**Writing.** Payloads are grouped by SHA-1.  Of the records with equal payloads of at least
``min_bytes``, that with the smallest id is a ``response``; the others are ``revisit``
records, which name it and hold HTTP headers but no payload.  Each task writes packages of
about ``package_bytes`` straight to the shared store, under names of their own; a manifest
table, committed by Spark, lists those of the tasks that counted.  A lost or repeated task
leaves at most files that no manifest names.

**Reading.** ``read_index`` parses each package's directories (``zip_archive``) and streams
its index members; ``read_records`` deals the records by package and stretch of bytes, so
that a large package is many tasks, and reads each record by its range.  Nothing is
extracted; neighbouring ranges are fetched together, at most ``SPAN`` bytes at a time unless
one record is longer.

Scale: digests are aggregated before any shuffle.  Payloads are shuffled once, by digest;
digests that hold over a thousandth of all rows (fewer than a thousand, so broadcast) leave
their rows spread.

Defined cases: a NULL payload is empty; an empty payload counts as a payload of 0 bytes; a
NULL id is never the smallest, a group of NULL ids alone is all responses; rows that repeat
the smallest id are all responses; a NULL URL is written as empty and read as NULL; line
ends, spaces and other signs in URLs and ids are percent-encoded; an empty table makes no
package; other columns of the table are left out.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import quoted, stored
from quarry.llm.zip_archive import ZipDirectory, open_store

MIN_BYTES, PACKAGE_BYTES, SPAN, LEVEL = 0, 64 << 20, 4 << 20, 6
RECORDS, DATE = "data.warc.gz", "2020-01-01T00:00:00Z"
RECORD_ID = "urn:x-record:"
PLAIN = "/:?&=#;,@!$'()*+~[]"


def bare_digest(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def record_bytes(record_id: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One WARC record; a revisit (``refers_to``) holds the HTTP headers only."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [("WARC-Type", "response" if refers_to is None else "revisit"),
            ("WARC-Record-ID", f"<{RECORD_ID}{quote(record_id or '', safe='')}>"), ("WARC-Date", DATE),
            ("WARC-Target-URI", quote(url or "", safe=PLAIN)), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if refers_to is None:
        block += payload
    else:
        head += [("WARC-Refers-To", f"<{RECORD_ID}{quote(refers_to, safe='')}>"),
                 ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    head += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def headers(raw: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in raw.decode().split("\r\n")[1:])}


def parse_record(raw: bytes) -> dict:
    """Fields of one WARC record with an HTTP response in its block."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/"):
        raise ValueError("no WARC record")
    fields = headers(head)
    block = rest[:int(fields["content-length"])]
    if len(block) != int(fields["content-length"]):
        raise ValueError("a truncated record")
    http, _, payload = block.partition(b"\r\n\r\n")

    def name(field: str) -> str | None:
        value = fields.get(field, "").strip("<>").removeprefix(RECORD_ID)
        return unquote(value) or None

    digest, revisit = fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"] == "revisit"
    if not revisit and bare_digest(hashlib.sha1(payload).digest()) != digest:
        raise ValueError("a payload that differs from its digest")
    return {"id": name("warc-record-id"), "url": name("warc-target-uri"), "record_type": fields["warc-type"],
            "payload_bytes": int(headers(http)["content-length"]), "payload_digest": digest,
            "refers_to": name("warc-refers-to"), "payload": None if revisit else payload}


class PackageWriter:
    """Packages of one task, one after another."""

    def __init__(self, folder: str, package_bytes: int, level: int):
        self.store, self.folder = open_store(folder)
        self.uri, self.limit, self.level, self.zip = folder, package_bytes, level, None

    def add(self, record: bytes, entry: dict, url: str | None) -> None:
        if self.zip is None:
            self.name = f"{uuid.uuid4().hex}.wacz"
            self.out = self.store.open_output_stream(f"{self.folder}/{self.name}")
            self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED)
            self.member = self.zip.open(zipfile.ZipInfo(f"archive/{RECORDS}"), "w", force_zip64=True)
            self.size, self.index = 0, []
        pack = zlib.compressobj(self.level, zlib.DEFLATED, 31)
        data = pack.compress(record) + pack.flush()
        self.member.write(data)
        line = json.dumps({**entry, "offset": self.size, "length": len(data), "filename": RECORDS})
        self.index.append(f"{quote(url or '', safe=PLAIN) or '-'} {DATE} {line}\n")
        self.size += len(data)

    def full(self) -> bool:
        return self.zip is not None and self.size >= self.limit

    def close(self) -> tuple[str, int, int]:
        """Finish the package: its place, its bytes of records and their number."""
        self.member.close()
        with self.zip.open(zipfile.ZipInfo("indexes/index.cdxj"), "w", force_zip64=True) as member:
            for line in sorted(self.index):
                member.write(line.encode())
        self.zip.close()
        self.out.close()
        self.zip = None
        return f"{self.uri}/{self.name}", self.size, len(self.index)


MANIFEST = "package string, record_bytes long, n_records long"


def _writer(folder: str, package_bytes: int, level: int):
    schema = pa.schema([("package", pa.string()), ("record_bytes", pa.int64()), ("n_records", pa.int64())])

    def row(package: tuple[str, int, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v]) for v in package], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packages = PackageWriter(folder, package_bytes, level)
        for batch in batches:
            for k in range(batch.num_rows):  # row by row: a batch is never held a second time
                id_, url, payload, sha1, first = (batch.column(c)[k].as_py() for c in range(5))
                digest = bare_digest(bytes.fromhex(sha1))
                entry = {"digest": f"sha1:{digest}", "mime": "text/html" if first is None else "warc/revisit"}
                packages.add(record_bytes(id_, url, payload, digest, first), entry, url)
                if packages.full():
                    yield row(packages.close())
        if packages.zip is not None:
            yield row(packages.close())
    return run


def with_first(pages: DataFrame, *, id_col: str, url_col: str, payload_col: str, min_bytes: int) -> DataFrame:
    """(id, url, payload, sha1, first): ``first`` is the id that a revisit refers to, NULL
    for a response."""
    rows = pages.select(quoted(id_col).alias("id"), quoted(url_col).cast("string").alias("url"),
                        F.coalesce(quoted(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload"))
    sized = rows.where(F.length("payload") >= min_bytes)
    groups = stored(sized.groupBy("sha1").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1"), "warc-groups")
    total = rows.count()
    hot = groups.where(F.col("n") * 1000 > total).select(F.col("sha1").alias("hot_sha1"), F.col("first").alias("hot_first"))
    rows = rows.join(F.broadcast(hot), F.col("sha1") == F.col("hot_sha1"), "left")  # under 1,000 rows
    # rows of hot digests keep a key of their own, so no task receives them all
    spread = F.concat(F.lit("-"), F.xxhash64("id", "url").cast("string"))
    rows = rows.withColumn("key", F.when(F.col("hot_sha1").isNull(), F.col("sha1")).otherwise(spread))
    cold = groups.where(F.col("n") * 1000 <= total).select(F.col("sha1").alias("key"), "first")
    rows = rows.join(cold, "key", "left")
    first = F.when(F.length("payload") >= min_bytes, F.coalesce("hot_first", "first"))
    return rows.select("id", "url", "payload", "sha1", F.when(~F.col("id").eqNullSafe(first), first).alias("first"))


def write_packages(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                   min_bytes: int = MIN_BYTES, package_bytes: int = PACKAGE_BYTES, level: int = LEVEL) -> DataFrame:
    """Write all rows as packages under ``path`` (a folder that driver and executors share);
    the manifest (package, record_bytes, n_records) is stored there and returned."""
    spark = pages.sparkSession
    folder = f"{path}/packages"
    store, place = open_store(folder)
    store.create_dir(place, recursive=True)
    rows = with_first(pages, id_col=id_col, url_col=url_col, payload_col=payload_col, min_bytes=min_bytes)
    rows = rows.select(F.col("id").cast("string"), "url", "payload", "sha1", F.col("first").cast("string"))
    rows.mapInArrow(_writer(folder, package_bytes, level), MANIFEST).write.parquet(f"{path}/manifest")
    return read_manifest(spark, path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")


def _index_reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["package", "at", "length"]
    for batch in batches:
        for package in batch.column(0).to_pylist():
            store, place = open_store(package)
            with store.open_input_file(place) as file:
                zipped = ZipDirectory(file)
                members = {m.name: m for m in zipped.members()}
                starts = {n.removeprefix("archive/"): zipped.data_start(m) for n, m in members.items() if n.startswith("archive/")}
                found = []
                for name in sorted(n for n in members if n.startswith("indexes/")):
                    for line in zipped.lines(members[name]):
                        entry = json.loads(line.split(b" ", 2)[2])
                        found.append((package, starts[entry["filename"]] + entry["offset"], entry["length"]))
                        if len(found) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found)], names)
                            found = []
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found)], names)


def tasks_for(packages: DataFrame, task_bytes: int = PACKAGE_BYTES) -> int:
    """Tasks that read the packages at about ``task_bytes`` of records each, and no fewer than
    the session shuffles to.  Rows that name byte ranges are small: left to itself, adaptive
    execution would put all of them into one task."""
    total = packages.agg(F.sum("record_bytes")).first()[0] or 0
    return max(-(-total // task_bytes), int(packages.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def read_index(packages: DataFrame, tasks: int | None = None) -> DataFrame:
    """(package, at, length): the byte range of every record, from the index members."""
    return (packages.select("package").repartition(tasks or tasks_for(packages), "package")
            .mapInArrow(_index_reader, "package string, at long, length long"))


def _record_reader(payloads: bool):
    schema = pa.schema([("package", pa.string()), ("at", pa.int64()), ("id", pa.string()), ("url", pa.string()),
                        ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                        ("refers_to", pa.string())] + ([("payload", pa.binary())] if payloads else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = file = None
        rows, held = [], 0

        def close() -> None:
            if file is not None:
                file.close()

        def stretches() -> Iterator[list[tuple[str, int, int]]]:
            """Neighbouring ranges of one package, at most ``SPAN`` bytes unless one is longer."""
            group: list[tuple[str, int, int]] = []
            for batch in batches:
                for item in zip(*(c.to_pylist() for c in batch.columns)):
                    if group and (item[0] != group[0][0] or item[1] != group[-1][1] + group[-1][2]
                                  or item[1] + item[2] - group[0][1] > SPAN):
                        yield group
                        group = []
                    group.append(item)
            if group:
                yield group

        for group in stretches():
            package, first = group[0][0], group[0][1]
            if package != name:
                close()
                store, place = open_store(package)
                name, file = package, store.open_input_file(place)
            file.seek(first)
            data = memoryview(file.read(group[-1][1] + group[-1][2] - first))
            for _, at, length in group:
                record = parse_record(zlib.decompress(data[at - first:at - first + length], 31))
                held += record["payload_bytes"] if payloads else 0
                rows.append({**record, "package": package, "at": at} if payloads
                            else {k: v for k, v in record.items() if k != "payload"} | {"package": package, "at": at})
                if len(rows) == 2_000 or held > SPAN:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
        close()
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)
    return run


def read_records(index: DataFrame, tasks: int, *, payloads: bool = False) -> DataFrame:
    """(package, at, id, url, record_type, payload_bytes, payload_digest, refers_to[,
    payload]) of the records in the given byte ranges, read by ``tasks`` tasks.  Every
    response's payload is held against its digest; a difference is an error."""
    fields = ("package string, at long, id string, url string, record_type string, payload_bytes long, "
              "payload_digest string, refers_to string" + (", payload binary" if payloads else ""))
    dealt = (index.repartition(tasks, "package", F.floor(F.col("at") / (4 * SPAN))).sortWithinPartitions("package", "at")
             .select("package", "at", "length"))
    return dealt.mapInArrow(_record_reader(payloads), fields)
