"""Legacy web archives: ARC files written, converted to WARC, and read back (operator 6).

``write_arc`` puts pages into ARC files of version 1 or 2.  ``convert`` reads ARC files as a stream: the version block names
the version, whose field list says how a record's header line is split, and each record's declared length says how
much of the stream is its own.  It makes the WARC records: warcinfo from the version block, response from HTTP documents,
resource from others, and revisit for a payload of MIN_REVISIT bytes or more that another record holds; identifiers are
name-based UUIDs of place and content, so a second conversion gives the same; 14-digit dates become ISO dates;
digests are SHA-256.  ``read_warc`` reads WARC files back and recomputes what the headers claim.

A file has a gzip member for each record.  It is written under a name of its own and renamed when it is whole, and read as a
stream, so a task holds one record at a time; each archive is converted and read by a task of its own.  Payloads aren't
shuffled: a first pass yields digests, their groups name the records that revisit others, and a file's list of those
goes to the task that converts it.

Nulls and odd input: a null html is an empty payload; a null url is "-", and white space and control characters in a url
are percent-encoded; a null page_id is read back as null and comes last among equal payloads; of repeated rows the first
in the archive is the response, the others revisit it; an empty table gives no record and no row.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import IO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearken.llm.common import open_fs, scratch, small_batches, stage, table

MIN_REVISIT = 100
#: Of compression: records are small and written twice.
LEVEL = 1
#: The date of records whose source has none.
DATE = "20200101000000"
#: The field lists of the two versions of the format; fixed values.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def _url(url: str | None) -> str:
    return _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url) if url else "-"


def arc_header(version: int, url: str, mime: str, n: int, name: str, offset: int, digest: str, date: str = DATE, ip: str = "0.0.0.0", status: str = "200") -> bytes:
    fields = [url, ip, date, mime] + ([status, digest, "-", str(offset), name] if version == 2 else []) + [str(n)]
    return " ".join(fields).encode("utf-8", "surrogatepass") + b"\n"


def arc_start(version: int, name: str) -> bytes:
    body = f"{version} 0 hearken\n{ARC_FIELDS[version]}\n".encode()
    return arc_header(version, f"filedesc://{name}", "text/plain", len(body), name, 0, "-") + body


class _Members:
    """A gzip file with a member for each record, under a name of its own until it is whole; so a task that is run again, or twice
    at a time, leaves one whole file."""

    def __init__(self, folder: str, name: str):
        self.fs, self.root = open_fs(folder)
        self.own, self.name = f"{self.root}/.{uuid.uuid4().hex}", f"{self.root}/{name}"
        self.out = self.fs.open_output_stream(self.own, compression=None)

    def add(self, record: bytes) -> None:
        self.out.write(gzip.compress(record, LEVEL, mtime=0))

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.own, self.name)


def _to_arc(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        version, name, offset, out = 1 + part % 2, f"pages-{part:06d}.arc", 0, None
        for b in batches:
            for page_id, url, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if out is None:
                    out, start = _Members(folder, name + ".gz"), arc_start(version, name)
                    out.add(start + b"\n")
                    offset = len(start) + 1
                payload = (html.as_py() or "").encode("utf-8", "surrogatepass")
                own = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
                block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n{own}\r\n".encode() + payload
                record = arc_header(version, _url(url), "text/html", len(block), name, offset, "-") + block
                out.add(record + b"\n")
                offset += len(record) + 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"name": [name]})

    return run


def _run(files: DataFrame) -> None:
    """Runs the tasks that write files."""
    with small_batches(files.sparkSession):
        files.write.format("noop").mode("overwrite").save()


def _folder(path: str) -> None:
    fs, root = open_fs(path)
    fs.create_dir(root)


def write_arc(pages: DataFrame, path: str) -> None:
    """A file for each partition of pages."""
    _folder(path)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    _run(rows.mapInArrow(_to_arc(path), "name string"))


def _open(uri: str) -> IO[bytes]:
    fs, path = open_fs(re.sub("^file:/(?!/)", "file:///", uri))
    raw = fs.open_input_stream(path, compression=None)
    return gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else raw  # type: ignore[return-value]


def _exactly(f: IO[bytes], n: int) -> bytes:
    data = f.read(n)
    while len(data) < n:
        if not (more := f.read(n - len(data))):
            raise EOFError(f"{n - len(data)} bytes of a record are missing")
        data += more
    return data


def arc_records(f: IO[bytes]) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, header fields by name, block) of each record; the version block is the first."""
    fields, at = None, 0
    while line := f.readline():
        if not line.strip():  # between records
            at += len(line)
            continue
        parts = line.decode("utf-8", "surrogateescape").rstrip("\r\n").split(" ")
        if fields is None:
            if not parts[0].startswith("filedesc://"):
                raise ValueError("an ARC file begins with its version block")
            block = _exactly(f, int(parts[-1]))
            version = int(block.split(b" ", 1)[0])
            fields = block.split(b"\n")[1].decode().split(" ")
            if fields != ARC_FIELDS.get(version, "").split(" "):
                raise ValueError(f"unknown fields of ARC version {version}")
            # a version 1 line has no more than its first four fields and the length; so has that of old version blocks
            names = fields if len(parts) == len(fields) else ARC_FIELDS[1].split(" ")
        else:
            names = fields
            if len(parts) > len(names):  # white space in the url
                extra = len(parts) - len(names)
                parts = ["%20".join(parts[: extra + 1]), *parts[extra + 1 :]]
            block = _exactly(f, int(parts[-1]))
        yield at, dict(zip(names, parts, strict=True)) | {"version": str(version)}, block
        at += len(line) + len(block)


def http_parts(block: bytes) -> tuple[dict[bytes, bytes], bytes, bytes]:
    """Headers by lower-case name, the head with its empty line, and the payload."""
    head, gap, payload = block.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in lines)}, head + gap, payload


def _page_id(headers: dict[bytes, bytes]) -> int | None:
    return int(headers[b"x-page-id"]) if b"x-page-id" in headers else None


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path in b.column(0).to_pylist():
            rows = []
            with _open(path) as f:
                for at, fields, block in arc_records(f):
                    if block.startswith(b"HTTP/") and fields["URL"][:11] != "filedesc://":
                        headers, _, payload = http_parts(block)
                        rows.append({"path": path, "at": at, "page_id": _page_id(headers), "n": len(payload), "digest": hashlib.sha256(payload).hexdigest(), "url": fields["URL"], "date": fields["Archive-date"]})
                    if len(rows) >= 5000:
                        yield pa.RecordBatch.from_pylist(rows, _DIGEST)
                        rows = []
            yield pa.RecordBatch.from_pylist(rows, _DIGEST)


_DIGEST = pa.schema([("path", pa.string()), ("at", pa.int64()), ("page_id", pa.int64()), ("n", pa.int64()), ("digest", pa.string()), ("url", pa.string()), ("date", pa.string())])


def record_id(*of: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join(map(str, of)))}>"


def iso_date(date: str) -> str:
    d = (date + "0" * 14)[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode("utf-8", "surrogateescape") + b"\r\n" + block


@dataclass
class First:
    """The record that a revisit refers to: its place among the ARC files, and what its headers say."""

    path: str
    at: int
    page: int | None
    url: str
    date: str


def warc_record(name: str, at: int, fields: dict[str, str], block: bytes, first: First | None = None) -> bytes:
    """One ARC record of the file of this name as a WARC record; first: the record with the same payload that it revisits."""
    url, kind, block_digest = fields["URL"], fields["Content-type"], hashlib.sha256(block).hexdigest()
    common = [("WARC-Record-ID", record_id(name, at)), ("WARC-Date", iso_date(fields["Archive-date"]))]
    if url.startswith("filedesc://"):
        info = f"software: hearken\r\nformat: WARC file version 1.1\r\nconverted-from: ARC version {fields['version']}\r\n".encode()
        return _record([("WARC-Type", "warcinfo"), *common, ("WARC-Filename", warc_name(url[11:])), ("Content-Type", "application/warc-fields")], info)
    common += [("WARC-Warcinfo-ID", record_id(name, 0)), ("WARC-Target-URI", url), ("WARC-IP-Address", fields["IP-address"])]
    if not block.startswith(b"HTTP/"):
        return _record([("WARC-Type", "resource"), *common, ("WARC-Block-Digest", f"sha256:{block_digest}"), ("Content-Type", kind)], block)
    _, head, payload = http_parts(block)
    common.append(("WARC-Payload-Digest", f"sha256:{hashlib.sha256(payload).hexdigest()}"))
    http = ("Content-Type", "application/http; msgtype=response")
    if first is None:
        return _record([("WARC-Type", "response"), *common, ("WARC-Block-Digest", f"sha256:{block_digest}"), http], block)
    common += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(_name(first.path), first.at))]
    common += [("WARC-Refers-To-Target-URI", first.url), ("WARC-Refers-To-Date", iso_date(first.date))]
    common += [] if first.page is None else [("X-Refers-To-Page-Id", str(first.page))]
    return _record([("WARC-Type", "revisit"), *common, http], head)


def _name(path: str) -> str:
    return path.rsplit("/", 1)[-1].removesuffix(".gz")


def warc_name(arc: str) -> str:
    return _name(arc).removesuffix(".arc") + ".warc.gz"


def _to_warc(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, again in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                of = {x.pop("own"): First(**x) for x in again or ()}
                out = _Members(folder, warc_name(path))
                with _open(path) as f:
                    for at, fields, block in arc_records(f):
                        out.add(warc_record(_name(path), at, fields, block, of.get(at)) + b"\r\n\r\n")
                out.close()
                yield pa.RecordBatch.from_pydict({"name": [path]})

    return run


def files(spark: SparkSession, path: str) -> DataFrame:
    """The archives of a folder, one a task: they are few rows, but hours of work."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*arc*").load(path).select("path", "length").filter("length > 0").select("path")
    return _one_a_task(found)


def _one_a_task(found: DataFrame) -> DataFrame:
    return found.repartitionByRange(max(1, found.count()), "path")


def convert(spark: SparkSession, arc: str, warc: str) -> None:
    """ARC files of a folder to WARC files of another, each to one."""
    _folder(warc)
    found = files(spark, arc)
    schema = "path string, at long, page_id long, n long, digest string, url string, date string"
    digests = stage(found.mapInArrow(_digests, schema), "digests")
    order = F.struct(F.col("page_id").isNull().alias("none"), F.col("page_id").alias("page"), "path", "at", "url", "date")
    repeated = digests.filter(F.col("n") >= MIN_REVISIT).groupBy("digest", "n").agg(F.min(order).alias("first"), F.count("*").alias("c")).filter("c > 1")
    repeated = stage(repeated.select("digest", "n", "first"), "repeated")
    again = digests.select("path", "at", "digest", "n").join(repeated, ["digest", "n"]).filter("path <> first.path or at <> first.at")
    # a file's list is as long as its records at most
    lists = again.groupBy(F.col("path").alias("of")).agg(F.collect_list(F.struct(F.col("at").alias("own"), "first.path", "first.at", "first.page", "first.url", "first.date")).alias("again"))
    lists = stage(lists, "revisits")
    _run(_one_a_task(found.join(lists, F.col("path") == F.col("of"), "left").select("path", "again")).mapInArrow(_to_warc(warc), "name string"))


def warc_records(f: IO[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record of a WARC stream."""
    while line := f.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins with {line[:40]!r}")
        headers: dict[str, str] = {}
        while (line := f.readline()).strip():
            k, _, v = line.decode("utf-8", "surrogateescape").partition(":")
            headers[k.strip().lower()] = v.strip()
        yield headers, _exactly(f, int(headers["content-length"]))


_PAGE = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("record_id", pa.string()), ("target_uri", pa.string()), ("date", pa.string())])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path in b.column(0).to_pylist():
            rows = []
            with _open(path) as f:
                for w, block in warc_records(f):
                    if w["warc-type"] not in ("response", "revisit"):
                        continue
                    headers, _, payload = http_parts(block)
                    digest, n, refers = w["warc-payload-digest"].removeprefix("sha256:"), int(headers[b"content-length"]), None
                    if w["warc-type"] == "response":
                        n = len(payload)
                        if hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"{path}: the payload of {w['warc-record-id']} has another digest")
                    elif "x-refers-to-page-id" in w:
                        refers = int(w["x-refers-to-page-id"])
                    rows.append(dict(zip(_PAGE.names, (_page_id(headers), n, digest, w["warc-type"], refers, w["warc-record-id"], w["warc-target-uri"], w["warc-date"]), strict=True)))
                    if len(rows) >= 5000:
                        yield pa.RecordBatch.from_pylist(rows, _PAGE)
                        rows = []
            yield pa.RecordBatch.from_pylist(rows, _PAGE)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """A row for each response and revisit record of a folder's WARC files."""
    return files(spark, path).mapInArrow(_read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, target_uri string, date string")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    arc, warc = scratch(spark, "arc"), scratch(spark, "warc")
    write_arc(table(spark, sf_dir, "pages"), arc)
    convert(spark, arc, warc)
    return read_warc(spark, warc).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
     m AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM p)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
FROM m
"""
