"""Web archives in ZIP packages: written by tasks, and read back by ranges without extraction.

A package is a ZIP file whose members are stored: ``archive/*.warc.gz`` (one gzip member per record) and
``indexes/*.cdxj`` (one JSON line per record with the record's place in its archive member). The reader parses the
central directory, ZIP64 or not, finds where the stored members begin, reads the indexes and then only
the byte ranges of the records asked for. A stored archive without an index is walked record by record.

``write`` -> packages(path, bytes, records); ``entries`` -> one row per record with its place; ``records`` -> contents.

Which record is the response: of rows with equal payloads of at least ``LEAST`` bytes the one with the least id, null ids
last, then the least url; the others become revisits. Of rows equal in id, url and payload any one is the response. Shorter payloads are all
responses. A null payload is empty; a null id or url is left out of the record and read back as null; a url's
spaces, control and non-ASCII characters are percent-encoded in the record and plain in the index; columns other than
the three named don't travel, so their names can't clash. An empty table gives no package and no rows. A payload of any length is one
record: it is held whole in one task, as Spark itself holds it. Packages roll over at ``PACKAGE_BYTES``.

Scale: one shuffle of the pages, by payload digest. Digests that hold over a thousandth of all rows are under a thousand: they are
broadcast, and their rows dealt out by id as well. Packages get a new name in every task attempt and only those of finished
tasks are listed, so a lost executor leaves no half package in use.
"""

from __future__ import annotations

import base64
import hashlib
import json
import posixpath
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote_to_bytes

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import scratch_root, stage
from .common import HOT_SHARE

#: Payloads of fewer bytes are always written in full.
LEAST = 100
#: Bytes of an archive member after which the next package begins.
PACKAGE_BYTES = 64 << 20
#: What a record costs besides its payload, for the number of packages.
RECORD_BYTES = 600
#: Bytes read at once, of a package and into one batch of records.
READ_BYTES = 4 << 20

# Fixed values of the two formats.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END_SIGN, END64_SIGN, LOCATOR_SIGN, ENTRY_SIGN, LOCAL_SIGN = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
END_SIZE, LOCATOR_SIZE, END64_SIZE, ENTRY_SIZE, LOCAL_SIZE = 22, 20, 56, 46, 30
LONGEST_COMMENT = 0xFFFF

PACKAGES = "path string, bytes bigint, records bigint"
ENTRIES = "path string, member string, offset bigint, length bigint, type string, id string, url string"
RECORDS = (
    "path string, offset bigint, type string, id string, url string, payload binary, payload_bytes bigint,"
    " payload_digest string, refers_to string"
)


# ---- writing ----------------------------------------------------------------------------------------


def _gzip(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _name(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, json.dumps(parts))}>"


def record(kind: str, own: str, date: str, id: str | None, url: str | None, payload: bytes, digest: str, first: str | None) -> bytes:
    """One WARC record; a revisit has the HTTP head of its payload only. Names of the form ``Page-*`` are ours."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = [
        ("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Date", date), ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
    ]
    if url is not None:
        head.append(("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~")))
    if id is not None:
        head.append(("Page-ID", quote(id, safe="")))
    if kind == "revisit":
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _name(first, digest))]
        if first is not None:
            head.append(("Page-Refers-To", quote(first, safe="")))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


class _Package:
    """A package under construction: records are appended to its archive, their places kept for its index."""

    def __init__(self, store: pafs.FileSystem, folder: str, root: str):
        name = f"{uuid.uuid4().hex}.wacz"
        self.path, self.place = posixpath.join(folder, name), posixpath.join(root, name)
        self.store, self.at, self.lines = store, 0, []
        self.out = store.open_output_stream(self.place)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED)
        self.archive = self.zip.open("archive/data.warc.gz", "w", force_zip64=True)

    def add(self, kind: str, id: str | None, url: str | None, data: bytes) -> None:
        data = _gzip(data)
        self.archive.write(data)
        line = {"filename": "data.warc.gz", "offset": self.at, "length": len(data), "type": kind, "id": id, "url": url}
        self.lines.append(json.dumps(line).encode())
        self.at += len(data)

    def close(self) -> dict:
        self.archive.close()
        with self.zip.open("indexes/index.cdxj", "w", force_zip64=True) as index:
            for line in self.lines:
                index.write(line + b"\n")
        self.zip.close()
        self.out.close()
        return {"path": self.path, "bytes": self.store.get_file_info(self.place).size, "records": len(self.lines)}


def _writer(folder: str, date: str, least: int, package_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder)
        package, answered = None, (None, None)
        done: list[dict] = []
        for batch in batches:
            for row in range(batch.num_rows):
                id, url, payload, digest, hot, first_id, first_url = (column[row].as_py() for column in batch.columns)
                kind, first = "response", None
                if len(payload) >= least:  # rows come by digest, least id first; the rows of a hot digest are in several tasks
                    if digest == answered[0]:
                        kind, first = "revisit", answered[1]
                    elif hot and (id, url) != (first_id, first_url):
                        kind, first = "revisit", first_id
                    else:
                        answered = digest, id
                if package is None:
                    package = _Package(store, folder, root)
                own = _name(id, digest) if kind == "response" else _name(package.path, package.at)
                package.add(kind, id, url, record(kind, own, date, id, url, payload, digest, first))
                if package.at >= package_bytes:
                    done.append(package.close())
                    package = None
        if package is not None:
            done.append(package.close())
        if done:
            yield pa.RecordBatch.from_pylist(done, pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())]))

    return run


def write(
    pages: DataFrame, folder: str, id: str = "page_id", url: str = "url", payload: str = "html",
    date: str = "2000-01-01T00:00:00Z", least: int = LEAST, package_bytes: int = PACKAGE_BYTES,
) -> DataFrame:
    """Write a record per row of ``pages`` into packages below ``folder``; returns (path, bytes, records), written too."""
    spark = pages.sparkSession
    rows = pages.select(
        F.col(id).alias("order"), F.col(id).cast("string").alias("id"), F.col(url).cast("string").alias("url"),
        F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    place = F.struct(F.col("order").isNull().alias("none"), "order", F.col("url").isNull().alias("bare"), "url", "id")
    cost = F.octet_length("payload") + RECORD_BYTES
    counts, seen = stage(
        rows.groupBy("digest").agg(
            F.count(F.lit(1)).alias("n"), F.min(place).alias("place"), F.sum(cost).alias("bytes"), F.max(F.octet_length("payload")).alias("size")
        ), "payloads", n=F.sum("n"), bytes=F.sum("bytes"),
    )
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(seen["bytes"] or 0) // package_bytes))
    # Each of these has over 1/HOT_SHARE of all rows, so there are fewer than HOT_SHARE.
    hot = counts.where(F.col("n") * HOT_SHARE > (seen["n"] or 0)).select(
        F.col("digest").alias("_digest"), F.col("place.id").alias("_id"), F.col("place.url").alias("_url")
    )
    dealt = (
        rows.join(F.broadcast(hot), F.col("digest") == F.col("_digest"), "left")
        .withColumn("salt", F.when(F.col("_digest").isNotNull(), F.pmod(F.xxhash64("id", "url"), F.lit(parts))).otherwise(0))
        .repartition(parts, "digest", "salt")
        .sortWithinPartitions("digest", F.col("order").asc_nulls_last(), F.col("url").asc_nulls_last())
    )
    store, root = pafs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    hot_row = F.col("_digest").isNotNull().alias("hot")
    made = dealt.select("id", "url", "payload", "digest", hot_row, "_id", "_url").mapInArrow(_writer(folder, date, least, package_bytes), PACKAGES)
    return stage(made, "packages")[0]


def written(pages: DataFrame, **options) -> DataFrame:
    """``write`` into a new folder of the session's shared folder."""
    root = scratch_root(pages.sparkSession)
    return write(pages, f"{root}/codeatlas/archives-{uuid.uuid4().hex}", **options)


# ---- ZIP directories --------------------------------------------------------------------------------


def _wide(extra: bytes, values: list[int], full: list[int]) -> list[int]:
    """The values of a directory entry, those at their limit taken from its ZIP64 field, in order."""
    at = 0
    while at + 4 <= len(extra):
        tag, size = struct.unpack_from("<HH", extra, at)
        if tag == 1:
            field, used, out = extra[at + 4:at + 4 + size], 0, []
            for value, limit in zip(values, full):
                if value == limit and used + 8 <= len(field):
                    value = struct.unpack_from("<Q", field, used)[0]
                    used += 8
                out.append(value)
            return out
        at += 4 + size
    return values


def directory(read, size: int) -> list[dict]:
    """Members of a ZIP file of ``size`` bytes: name, method, and where its data begins and how long they are.

    ``read(offset, length)`` reads a range. Bytes in front of the file (a self-extractor) and a comment behind it are allowed.
    """
    tail_at = max(0, size - END_SIZE - LONGEST_COMMENT)
    tail = read(tail_at, size - tail_at)
    at = len(tail)
    while True:
        at = tail.rfind(END_SIGN, 0, at)
        if at < 0:
            raise ValueError("not a ZIP file: no end of central directory")
        if at + END_SIZE <= len(tail) and at + END_SIZE + struct.unpack_from("<H", tail, at + 20)[0] == len(tail):
            break
    count, length, begin = struct.unpack_from("<HII", tail, at + 10)
    end = tail_at + at
    locator = read(end - LOCATOR_SIZE, LOCATOR_SIZE) if end >= LOCATOR_SIZE else b""
    wide = b""
    if locator[:4] == LOCATOR_SIGN:  # a ZIP64 end may stand in front even if no value needs it
        for place in (struct.unpack_from("<Q", locator, 8)[0], end - LOCATOR_SIZE - END64_SIZE):
            wide = read(place, END64_SIZE) if 0 <= place <= end - END64_SIZE else b""
            if wide[:4] == END64_SIGN:
                count, length, begin = struct.unpack_from("<QQQ", wide, 32)
                end = place
                break
    if wide[:4] != END64_SIGN and (count == 0xFFFF or 0xFFFFFFFF in (length, begin)):
        raise ValueError("damaged ZIP64 directory")
    front = end - length - begin
    listing, out, at = read(begin + front, length), [], 0
    for _ in range(count):
        if listing[at:at + 4] != ENTRY_SIGN:
            raise ValueError("damaged central directory")
        method, packed, full, n_name, n_extra, n_comment = struct.unpack_from("<H8xIIHHH", listing, at + 10)
        local = struct.unpack_from("<I", listing, at + 42)[0]
        name = listing[at + ENTRY_SIZE:at + ENTRY_SIZE + n_name]
        extra = listing[at + ENTRY_SIZE + n_name:at + ENTRY_SIZE + n_name + n_extra]
        full, packed, local = _wide(extra, [full, packed, local], [0xFFFFFFFF] * 3)
        out.append({"name": name.decode("utf-8", "replace"), "method": method, "local": local + front, "length": packed})
        at += ENTRY_SIZE + n_name + n_extra + n_comment
    return out


def _begin(read, member: dict) -> int:
    """Where the data of a member begin: behind its local header, whose name and extra field may differ from the directory's."""
    head = read(member["local"], LOCAL_SIZE)
    if head[:4] != LOCAL_SIGN:
        raise ValueError("damaged local header")
    return member["local"] + LOCAL_SIZE + sum(struct.unpack_from("<HH", head, 26))


# ---- reading ----------------------------------------------------------------------------------------


def _lines(read, start: int, length: int) -> Iterator[bytes]:
    rest, at = b"", start
    while at < start + length:
        part = read(at, min(READ_BYTES, start + length - at))
        at += len(part)
        *whole, rest = (rest + part).split(b"\n")
        yield from whole
    if rest:
        yield rest


def _walk(read, start: int, length: int) -> Iterator[tuple[int, int, bytes]]:
    """Place, length and content of every gzip member of an archive without an index."""
    at, end = start, start + length
    while at < end:
        unpack, out, here = zlib.decompressobj(31), [], at
        while not unpack.eof and here < end:
            part = read(here, min(READ_BYTES, end - here))
            out.append(unpack.decompress(part))
            here += len(part)
        here -= len(unpack.unused_data)
        if here <= at:
            raise ValueError("damaged archive member")
        yield at, here - at, b"".join(out)
        at = here


def parse(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Named fields of a record (lower case), its HTTP head and its payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    lines = re.sub(rb"\r\n[ \t]+", b" ", head).split(b"\r\n")[1:]
    fields = {k.strip().lower().decode(): v.strip().decode("utf-8", "replace") for k, _, v in (x.partition(b":") for x in lines)}
    block = rest[:int(fields.get("content-length", "0"))]
    if not fields.get("content-type", "").startswith("application/http"):
        return fields, b"", block
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, http, payload


def _text(value: str | None) -> str | None:
    return None if value is None else unquote_to_bytes(value).decode("utf-8", "replace")


def _row(path: str, offset: int, data: bytes) -> dict:
    fields, http, payload = parse(data)
    kind = fields.get("warc-type")
    row = {"path": path, "offset": offset, "type": kind, "id": _text(fields.get("page-id")), "url": fields.get("warc-target-uri")}
    if kind != "revisit":
        return row | {"payload": payload, "payload_bytes": len(payload), "payload_digest": hashlib.sha256(payload).hexdigest(), "refers_to": None}
    stated = fields.get("warc-payload-digest", "").removeprefix("sha256:")
    if re.fullmatch(r"[A-Z2-7]{52}(====)?", stated):  # some writers use base 32
        stated = base64.b32decode(stated.rstrip("=") + "====").hex()
    length = re.search(rb"(?im)^content-length:\s*([0-9]+)", http)
    return row | {
        "payload": None, "payload_bytes": int(length[1]) if length else None, "payload_digest": stated or None,
        "refers_to": _text(fields.get("page-refers-to")),
    }


def _opened(path: str):
    store, at = pafs.FileSystem.from_uri(path)
    return store.open_input_file(at)


def _batches(rows: Iterator[tuple[dict, int]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row, cost in rows:
        held.append(row)
        size += cost
        if size >= READ_BYTES:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


ENTRY_SCHEMA = pa.schema([
    ("path", pa.string()), ("member", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string()),
    ("id", pa.string()), ("url", pa.string()),
])
RECORD_SCHEMA = pa.schema([
    ("path", pa.string()), ("offset", pa.int64()), ("type", pa.string()), ("id", pa.string()), ("url", pa.string()),
    ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.string()),
])


def _listed(path: str) -> Iterator[dict]:
    with _opened(path) as file:
        read = lambda at, n: file.read_at(n, at)
        members = [m for m in directory(read, file.size()) if m["method"] == 0 and m["length"]]
        archives = {m["name"]: m for m in members if re.search(r"\.warc(\.gz)?$", m["name"])}
        begins: dict[str, int] = {}
        for index in (m for m in members if re.search(r"\.cdxj?$", m["name"])):
            for line in _lines(read, _begin(read, index), index["length"]):
                found = line[line.find(b"{"):]
                if not found.startswith(b"{"):
                    continue
                entry = json.loads(found)
                member = next((a for a in (f"archive/{entry['filename']}", entry["filename"]) if a in archives), None)
                if member is None:
                    continue
                if member not in begins:
                    begins[member] = _begin(read, archives[member])
                yield {
                    "path": path, "member": member, "offset": begins[member] + int(entry["offset"]), "length": int(entry["length"]),
                    "type": entry.get("type"), "id": entry.get("id"), "url": entry.get("url"),
                }
        for name, member in archives.items():
            if name not in begins and name.endswith(".gz"):
                for at, length, data in _walk(read, _begin(read, member), member["length"]):
                    row = _row(path, at, data)
                    yield {"path": path, "member": name, "offset": at, "length": length} | {k: row[k] for k in ("type", "id", "url")}


def entries(packages: DataFrame) -> DataFrame:
    """One row per record of ``packages(path)``, with its place in its package."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(
            ((row, 400) for batch in batches for path in batch.column("path").to_pylist() for row in _listed(path)), ENTRY_SCHEMA
        )

    return packages.select("path").mapInArrow(run, ENTRIES)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, int]]:
    path = file = None
    start, held = 0, b""
    try:
        for batch in batches:
            for at, n, where in zip(*(batch.column(c).to_pylist() for c in ("offset", "length", "path"))):
                if where != path:
                    if file is not None:
                        file.close()
                    path, file, start, held = where, _opened(where), 0, b""
                if not start <= at <= at + n <= start + len(held):  # neighbours come with one read
                    start, held = at, file.read_at(max(n, READ_BYTES // 4), at)
                data = zlib.decompress(held[at - start:at - start + n], 31)
                yield _row(path, at, data), len(data) + 400
    finally:
        if file is not None:
            file.close()


def records(entries: DataFrame) -> DataFrame:
    """Contents of the records at ``entries(path, offset, length)``, read by range.

    A revisit has no payload; its size and digest are those its record states, and ``refers_to`` is its response's id.
    """
    return entries.select("path", "offset", "length").mapInArrow(lambda batches: _batches(_read(batches), RECORD_SCHEMA), RECORDS)


def read(packages: DataFrame) -> DataFrame:
    """All records of ``packages(path)``, a few packages to a task."""
    return records(entries(packages.repartition(max(1, packages.count()))))
