"""WARC records in ZIP packages, written by tasks and range-read.

A package holds, all stored plainly (not compressed by ZIP):
``archive/data.warc.gz`` (one gzip member per record, so any record can be
read alone), ``indexes/records.tsv`` (page id, offset, length, type) and
``datapackage.json``.  A task writes packages of about ``package_bytes``
each; the committed table of packages is what is read.

Of pages with equal payloads of at least ``revisit_bytes`` bytes, the one
with the smallest id is a response and the others are revisits of it.  Only
hashes that occur more than once are joined to the pages, one row per hash.

Defined results
---------------
* null html is an empty payload; payloads below ``revisit_bytes`` are all
  responses; a null url is written without a target.
* pages without an id: revisits when a page with an id has the payload,
  else responses.
* repeated rows of the kept id are all responses.
* an empty table gives no package and an empty result; other columns are
  ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blobs import new_file, open_read, open_write
from .common import empty_if_null, new_folder, write_table
from .zip_reader import ZipReader

RECORDS, INDEX = "archive/data.warc.gz", "indexes/records.tsv"
READ_AHEAD = 1 << 22
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_types(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
                 html_col: str = "html", revisit_bytes: int = 100) -> DataFrame:
    """``page_id, url, payload, digest, refers_to`` (null: a response)."""
    payload = empty_if_null(F.col(html_col)).cast("binary")
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
        payload.alias("payload"), F.unhex(F.sha2(payload, 256)).alias("digest"))
    kept = write_table(
        rows.where(F.octet_length("payload") >= revisit_bytes).groupBy("digest")
        .agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first_id"))
        .where("n > 1").select("digest", "first_id"), "warc-repeated")
    return rows.join(kept, "digest", "left").select(
        "page_id", "url", "payload", "digest",
        F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id")).alias("refers_to"))


def _record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def _record(page_id, url, payload: bytes, digest: bytes, refers_to, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_record_id(page_id)}", f"WARC-Date: {date}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest.hex()}", f"Content-Length: {len(body)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=_URL_SAFE)}")
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


_URL_SAFE = "".join(chr(c) for c in range(33, 127) if chr(c) != "%")


class _Package:
    def __init__(self, folder: str):
        self.uri = new_file(folder, ".zip")
        self.sink = open_write(self.uri)
        self.zip = zipfile.ZipFile(self.sink, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open(zipfile.ZipInfo(RECORDS), "w", force_zip64=True)
        self.at, self.index = 0, []

    def add(self, page_id, kind: str, record: bytes) -> None:
        packed = gzip.compress(record, 6, mtime=0)
        self.member.write(packed)
        self.index.append(f"{'' if page_id is None else page_id}\t{self.at}\t{len(packed)}\t{kind}\n")
        self.at += len(packed)

    def close(self) -> tuple[str, int]:
        self.member.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), "".join(self.index))
        self.zip.writestr(zipfile.ZipInfo("datapackage.json"), json.dumps(
            {"resources": [{"path": RECORDS, "bytes": self.at}, {"path": INDEX, "records": len(self.index)}]}))
        self.zip.close()
        self.sink.close()
        return self.uri, len(self.index)


def write_packages(rows: DataFrame, date: str = "1970-01-01T00:00:00Z", package_bytes: int = 1 << 26) -> DataFrame:
    """Write the records of a ``record_types`` frame; ``path, records`` of
    every package."""
    folder = new_folder(rows.sparkSession, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        package, done = None, []
        for b in batches:
            cols = [b.column(c) for c in ("page_id", "url", "payload", "digest", "refers_to")]
            for values in zip(*cols):
                page_id, url, payload, digest, refers_to = (v.as_py() for v in values)
                package = package or _Package(folder)
                package.add(page_id, "response" if refers_to is None else "revisit",
                            _record(page_id, url, payload, digest, refers_to, date))
                if package.at >= package_bytes:
                    done.append(package.close())
                    package = None
        if package is not None:
            done.append(package.close())
        yield pa.RecordBatch.from_arrays(
            [pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())],
            ["path", "records"])

    return write_table(rows.mapInArrow(write, "path string, records long"), "warc-packages")


def locate_records(packages: DataFrame) -> DataFrame:
    """The packages' own indexes: ``path, page_id, at, size, kind``, read
    through the directory of each package."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column("path").to_pylist():
                with open_read(path) as f:
                    lines = ZipReader(f).read(INDEX).decode().splitlines()
                fields = [line.split("\t") for line in lines]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * len(fields), pa.string()),
                     pa.array([int(x[0]) if x[0] else None for x in fields], pa.int64()),
                     pa.array([int(x[1]) for x in fields], pa.int64()),
                     pa.array([int(x[2]) for x in fields], pa.int64()),
                     pa.array([x[3] for x in fields], pa.string())], ["path", "page_id", "at", "size", "kind"])

    return packages.select("path").mapInArrow(run, "path string, page_id long, at long, size long, kind string")


def _parse(packed: bytes) -> tuple[dict, bytes, bytes]:
    """Headers, HTTP head and payload of one gzip member."""
    raw = zlib.decompress(packed, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    body = rest[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    return fields, http, payload


def read_records(located: DataFrame, with_payload: bool = True) -> DataFrame:
    """Range-read the located records (any subset of ``locate_records``).

    ``page_id, url, payload_bytes, payload_digest, record_type, refers_to``
    and with ``with_payload`` the ``payload`` of responses.  A response's
    digest and size are computed from the bytes read and must equal its
    header; a revisit's come from its header."""
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    names += ["payload"] * with_payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, file, zip_, buf, buf_at = None, None, None, b"", 0
        for b in batches:
            out: list[list] = [[] for _ in names]
            for p, at, size in zip(*(b.column(c).to_pylist() for c in ("path", "at", "size"))):
                if p != path:
                    if file is not None:
                        file.close()
                    path, file = p, open_read(p)
                    zip_, buf, buf_at = ZipReader(file), b"", 0
                if not buf_at <= at <= at + size <= buf_at + len(buf):
                    whole = zip_.members[RECORDS].size
                    buf, buf_at = zip_.read_range(RECORDS, at, max(size, min(READ_AHEAD, whole - at))), at
                fields, http, payload = _parse(buf[at - buf_at:at - buf_at + size])
                digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                length = int(http.decode().rpartition("Content-Length: ")[2])
                if fields["WARC-Type"] == "response":
                    if hashlib.sha256(payload).hexdigest() != digest or len(payload) != length:
                        raise ValueError(f"damaged record at {at} of {path}")
                values = [int(fields["X-Page-ID"]) if "X-Page-ID" in fields else None,
                          unquote(fields["WARC-Target-URI"]) if "WARC-Target-URI" in fields else None,
                          length, digest, fields["WARC-Type"],
                          int(fields["X-Refers-To-Page-ID"]) if "X-Refers-To-Page-ID" in fields else None]
                if with_payload:
                    values.append(payload if fields["WARC-Type"] == "response" else None)
                for column, v in zip(out, values):
                    column.append(v)
            types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)
        if file is not None:
            file.close()

    schema = ("page_id long, url string, payload_bytes long, payload_digest string, "
              "record_type string, refers_to long") + ", payload binary" * with_payload
    return located.mapInArrow(run, schema)
