"""Archives in ZIP packages: round trips, ZIP64, foreign packages, ranges, and the response of each payload."""

import hashlib
import io
import json
import zipfile
import zlib

import pytest

from codeatlas.llm import warc

PAGE = "page_id bigint, url string, html string"


def expected(rows, least=warc.LEAST):
    """(id, bytes, digest, type, refers_to) by a plain pass."""
    first = {}
    for id, url, html in rows:
        data = (html or "").encode()
        key = (id is None, id or 0, url is None, url or "")
        if len(data) >= least:
            first[data] = min(first.get(data, (key, id)), (key, id), key=lambda x: x[0])
    out, answered = [], set()
    for id, url, html in rows:
        data = (html or "").encode()
        key = (id is None, id or 0, url is None, url or "")
        kind, refers = "response", None
        if len(data) >= least:
            if first[data][0] != key or data in answered:
                kind, refers = "revisit", first[data][1]
            else:
                answered.add(data)
        out.append((id, len(data), hashlib.sha256(data).hexdigest(), kind, refers))
    return sorted(out, key=repr)


def got(records):
    as_id = lambda x: None if x is None else int(x)
    return sorted(((as_id(r.id), r.payload_bytes, r.payload_digest, r.type, as_id(r.refers_to)) for r in records), key=repr)


ROWS = [
    (3, "http://a/é x", "é" * 60), (1, "http://b", "é" * 60), (2, None, "é" * 60), (4, "u", "x" * 99), (5, "u", "x" * 99),
    (6, "u", "x" * 100), (7, "u", "x" * 100), (8, "u", None), (9, "u", ""), (None, "n", "y" * 200), (None, "m", "y" * 200),
    (10, "same", "z\r\n\r\n" * 50), (10, "same", "z\r\n\r\n" * 50), (10, "other", "z\r\n\r\n" * 50), (11, "big", "long " * 900_000),
    (12, "a%20b", "WARC/1.1\r\n\r\n" * 20 + "\U0001f600"),
]


def test_round_trip(spark):
    pages = spark.createDataFrame([(*r, r[2], 1) for r in ROWS], PAGE + ", payload string, offset int").repartition(3)
    packages = warc.written(pages, package_bytes=1 << 16)
    back = warc.read(packages).collect()
    assert got(back) == expected(ROWS)
    texts = {(h or "").encode() for _, _, h in ROWS}
    assert {bytes(r.payload) for r in back if r.type == "response"} == texts
    assert all(r.payload is None for r in back if r.type == "revisit")
    assert {r.url for r in warc.entries(packages).collect()} == {u for _, u, _ in ROWS}
    assert "http://a/%C3%A9%20x" in {r.url for r in back} and "a%20b" in {r.url for r in back}


def test_hot_payload_is_dealt_out(spark):
    """One payload holds two thirds of the rows: its records are in many packages, with one response."""
    rows = [(k, f"u{k}", "same " * 30 if k % 3 else f"page {k} " * 20) for k in range(3000)]
    packages = warc.written(spark.createDataFrame(rows, PAGE))
    assert got(warc.read(packages).collect()) == expected(rows)
    hot = warc.read(packages).where("payload_digest = '%s'" % hashlib.sha256(b"same " * 30).hexdigest()).groupBy("path").count()
    sizes = [r["count"] for r in hot.collect()]
    assert len(sizes) >= 4 and max(sizes) < 1000


def test_empty_table(spark):
    packages = warc.written(spark.createDataFrame([], PAGE))
    assert packages.count() == 0 and warc.read(packages).count() == 0


def test_text_ids(spark):
    rows = [("b", "u", "t" * 120), ("a", "v", "t" * 120)]
    back = warc.read(warc.written(spark.createDataFrame(rows, "name string, at string, body string"), id="name", url="at", payload="body"))
    assert {(r.id, r.type, r.refers_to) for r in back.collect()} == {("a", "response", None), ("b", "revisit", "a")}


def test_only_the_ranges_asked_for_are_read(spark, monkeypatch):
    rows = [(k, f"u{k}", hashlib.sha256(str(k).encode()).hexdigest() * 400) for k in range(200)]
    package = warc.written(spark.createDataFrame(rows, PAGE).coalesce(1)).collect()[0].path
    listed = list(warc._listed(package))
    asked = [e for e in listed if e["id"] in ("7", "190")] or listed[:1]
    read = []

    class Counting:
        def __init__(self, file):
            self.file = file

        def read_at(self, n, at):
            read.append(n)
            return self.file.read_at(n, at)

        def close(self):
            self.file.close()

    opened = warc._opened
    monkeypatch.setattr(warc, "_opened", lambda path: Counting(opened(path)))
    monkeypatch.setattr(warc, "READ_BYTES", 4)
    import pyarrow as pa

    batch = pa.RecordBatch.from_pylist([{k: e[k] for k in ("path", "offset", "length")} for e in asked])
    assert [r["id"] for r, _ in warc._read(iter([batch]))] == [e["id"] for e in asked]
    assert sum(read) == sum(e["length"] for e in asked)


def reader(data):
    return (lambda at, n: data[at:at + n]), len(data)


def package(index=True, comment=b"", front=b"", method=zipfile.ZIP_STORED):
    out = io.BytesIO()
    parts = [warc._gzip(warc.record("response", f"<urn:{k}>", "d", str(k), "u", b"p%d" % k, "0", None)) for k in range(3)]
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("datapackage.json", "{}", zipfile.ZIP_DEFLATED)
        z.writestr("archive/data.warc.gz", b"".join(parts), method)
        if index:
            at, lines = 0, []
            for k, p in enumerate(parts):
                lines.append("com,x)/ 2020 " + json.dumps({"filename": "data.warc.gz", "offset": str(at), "length": str(len(p)), "id": str(k)}))
                at += len(p)
            z.writestr("indexes/index.cdxj", "\n".join(["!meta", *lines]))
        z.comment = comment
    return front + out.getvalue()


@pytest.mark.parametrize("index", [True, False])
@pytest.mark.parametrize("comment, front", [(b"", b""), (b"PK\x05\x06 a comment that looks like an end", b""), (b"c", b"#!/bin/sh\n" * 9)])
def test_foreign_packages(spark, tmp_path, index, comment, front):
    at = tmp_path / "x.wacz"
    at.write_bytes(package(index, comment, front))
    packages = spark.createDataFrame([(str(at),)], "path string")
    assert {(r.id, bytes(r.payload)) for r in warc.read(packages).collect()} == {(str(k), b"p%d" % k) for k in range(3)}


def test_packed_members_are_not_read_as_records(spark, tmp_path):
    (tmp_path / "x.wacz").write_bytes(package(method=zipfile.ZIP_DEFLATED))
    assert warc.entries(spark.createDataFrame([(str(tmp_path / "x.wacz"),)], "path string")).count() == 0


def test_zip64_directory(monkeypatch):
    """Many members need a ZIP64 end; wide sizes and offsets need ZIP64 fields."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k in range(70_000):
            z.writestr(zipfile.ZipInfo(f"m{k}"), b"")
        z.writestr("last", b"here")
    read, size = reader(out.getvalue())
    members = warc.directory(read, size)
    assert len(members) == 70_001 and members[-1]["name"] == "last"
    assert read(warc._begin(read, members[-1]), members[-1]["length"]) == b"here"
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a", b"1" * 50)
        z.writestr("b", b"2" * 60)
    data = out.getvalue()
    read, size = reader(data)
    wide = warc.directory(read, size)
    assert [(m["name"], read(warc._begin(read, m), m["length"])) for m in wide] == [("a", b"1" * 50), ("b", b"2" * 60)]
    assert warc.END64_SIGN in data


def test_damage_is_an_error():
    with pytest.raises(ValueError):
        warc.directory(*reader(b"no archive at all"))
    with pytest.raises(ValueError):
        warc.parse(b"HTTP/1.1 200 OK\r\n\r\n")
    with pytest.raises((ValueError, zlib.error)):
        list(warc._walk(lambda at, n: b"x" * n, 0, 50))
