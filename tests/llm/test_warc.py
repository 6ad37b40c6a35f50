from __future__ import annotations

import hashlib
import io
import zipfile

import pytest

from storeflow.llm.warc import locate_records, read_records, record_types, write_packages
from storeflow.llm.zip_reader import ZipReader

from .helpers import clashing, frame, rows_of

DDL = "page_id long, url string, html string"
BIG = "<p>" + "long enough to be worth a revisit " * 5 + "</p>"
PAGES = [
    (5, "http://a/5", BIG), (3, "http://a/3?x=1&y=%20#z", BIG), (9, None, BIG), (3, "http://a/3", BIG),
    (None, "http://a/none", BIG), (1, "u\r\nX-Evil: 1", "short"), (2, "http://a/2", "short"),
    (4, "", None), (6, "http://é/", ""), (7, "http://a/7", "é" * 60), (8, "http://a/8", "é" * 60),
    (10, "http://a/10", "x" * 300000), (None, "http://a/n", "only here " * 20), (11, "http://a/11", "\r\n\r\n" * 50),
]


class File(io.BytesIO):
    def size(self):
        return len(self.getbuffer())


def archive(members, **kw):
    f = File()
    with zipfile.ZipFile(f, "w", **kw) as z:
        for name, data in members.items():
            z.writestr(zipfile.ZipInfo(name), data)
    return f


def test_directory_and_ranges():
    f = archive({"a": b"0123456789", "dir/é": b"", "b": b"xyz"})
    z = ZipReader(f)
    assert sorted(z.members) == ["a", "b", "dir/é"]
    assert z.read("a") == b"0123456789" and z.read_range("a", 3, 4) == b"3456" and z.read("dir/é") == b""
    with pytest.raises(ValueError):
        z.read_range("a", 8, 3)


def test_zip64_directory(monkeypatch):
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 20)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 3)
    members = {f"m{i}": bytes([65 + i]) * (15 + 10 * i) for i in range(6)}
    f = archive(members)
    monkeypatch.undo()
    assert b"PK\x06\x06" in f.getvalue()
    z = ZipReader(f)
    assert {n: z.read(n) for n in z.members} == members


def test_refusals():
    with pytest.raises(ValueError):
        ZipReader(File(b"not a zip"))
    packed = File()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a", b"x" * 1000)
    with pytest.raises(ValueError):
        ZipReader(packed).read("a")


def test_comment_with_end_signature():
    f = archive({"a": b"1"})
    with zipfile.ZipFile(f, "a") as z:
        z.comment = b"PK\x05\x06 in a comment"
    assert ZipReader(f).read("a") == b"1"


def brute():
    ids = {}
    for i, _, h in PAGES:
        if i is not None and len((h or "").encode()) >= 100:
            ids.setdefault(h, []).append(i)
    out = []
    for i, url, h in PAGES:
        raw = (h or "").encode()
        first = min(ids[h]) if h in ids else None
        to = first if first is not None and first != i else None
        out.append((i, url, len(raw), hashlib.sha256(raw).hexdigest(), "response" if to is None else "revisit", to,
                    raw if to is None else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("size", [1 << 26, 1])
def test_round_trip(spark, size):
    pages = clashing(frame(spark, PAGES, DDL)).repartition(3)
    packages = write_packages(record_types(pages), package_bytes=size)
    located = locate_records(packages)
    got = [tuple(r[c] if c != "payload" else r[c] and bytes(r[c]) for c in (
        "page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"))
        for r in rows_of(read_records(located))]
    got = [g[:6] + (b"" if g[6] is None and g[4] == "response" else g[6],) for g in got]
    assert sorted(got, key=repr) == brute()
    # any subset of records can be read alone
    some = rows_of(read_records(located.where("page_id IN (7, 10)"), with_payload=False))
    assert sorted(r["page_id"] for r in some) == [7, 10]


def test_empty(spark):
    packages = write_packages(record_types(frame(spark, [], DDL)))
    assert rows_of(packages) == [] and rows_of(read_records(locate_records(packages))) == []
