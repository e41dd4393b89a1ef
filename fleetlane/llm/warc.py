"""WARC records in ZIP packages: writing, and range reads without extraction.

A package is a ZIP file whose members are stored, not deflated: a
``archive/data.warc.gz`` of one gzip member per record and a
``indexes/index.cdx`` with offset, length, type and page of every record.
The reader never extracts a package.  It reads the end of the file, follows
the ZIP64 locator where there is one, parses the central directory, finds
the stored members and their data, reads the index (or, if a package has
none, walks the gzip members), and then reads single records by their byte
range.

Writing: of records with equal payloads of at least ``min_revisit`` bytes
the one with the largest page_id is a response; the others are revisits
that refer to it and hold no payload.  A partition writes packages of a
bounded size into the shared folder under names of its own; only names
handed on by a finished task are read, so packages of lost tasks are
ignored.

Edge cases: a null html is an empty payload; a null page_id is written
without an id, and never refers or is referred to; repeated rows of a page
are responses if their page is the group's largest; empty tables give no
packages; extra columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class WarcParams:
    min_revisit: int = 1000
    package_bytes: int = 32 << 20   # of records, compressed, in a package
    read_rows: int = 2000           # records read by one task, about


DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
_DATE = "2024-01-01T00:00:00Z"


def record_id(page_id: int | None) -> str:
    """A version-8 UUID that holds the page's 64 bits (random without one)."""
    if page_id is None:
        return uuid.uuid4().urn
    x = page_id & 0xFFFFFFFFFFFFFFFF
    return str(uuid.UUID(int=((x >> 32) << 96) | (0x8 << 76) | (0x8 << 60) | (x & 0xFFFFFFFF)).urn)


def page_of(urn: str | None) -> int | None:
    if not urn:
        return None
    v = uuid.UUID(urn.strip("<>").removeprefix("urn:uuid:")).int
    if (v >> 76) & 0xF != 8:
        return None
    x = ((v >> 96) << 32) | (v & 0xFFFFFFFF)
    return x - (1 << 64) if x >> 63 else x


def _record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    kind = "response" if refers_to is None else "revisit"
    block = http + (payload if refers_to is None else b"")
    # a URL is one header line: control characters are percent-coded
    target = "".join(c if c >= " " else f"%{ord(c):02X}" for c in url or "urn:none")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id(page_id)}>", f"WARC-Date: {_DATE}",
            f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: <{record_id(refers_to)}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """One WARC record -> page_id, payload_bytes, payload_digest,
    record_type, refers_to (both figures of the full payload)."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    h = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[:int(h["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in
              (x.partition(":") for x in http.decode("latin-1").split("\r\n")[1:])}
    stated = base64.b32decode(h["warc-payload-digest"].removeprefix("sha1:")).hex()
    if h["warc-type"] == "response":
        digest, size = hashlib.sha1(payload).hexdigest(), len(payload)
        if digest != stated:
            raise ValueError("payload differs from its digest")
    else:
        digest, size = stated, int(fields["content-length"])
    return {"page_id": page_of(h.get("warc-record-id")), "url": h.get("warc-target-uri"), "payload_bytes": size,
            "payload_digest": digest, "record_type": h["warc-type"], "refers_to": page_of(h.get("warc-refers-to"))}


def _package(records: bytes, index: list[str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
        for name, data in ((DATA, records), (INDEX, "\n".join(index).encode())):
            with z.open(zipfile.ZipInfo(name), "w", force_zip64=True) as m:
                m.write(data)
    return out.getvalue()


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def _write(root: str, p: WarcParams):
    def fn(batches):
        fs, base = open_fs(root)
        data, index = bytearray(), []

        def flush():
            name = f"{uuid.uuid4().hex}.zip"
            with fs.open_output_stream(f"{base}/{name}") as f:
                f.write(_package(bytes(data), index))
            n = len(index)
            data.clear(), index.clear()
            return pa.RecordBatch.from_arrays([pa.array([f"{root}/{name}"]), pa.array([n], pa.int64())],
                                              names=["path", "records"])

        for b in batches:
            cols = [b.column(i).to_pylist() for i in range(5)]
            for page, url, html, digest, refers in zip(*cols):
                gz = gzip.compress(_record(page, url, (html or "").encode(), digest, refers), 1, mtime=0)
                kind = "response" if refers is None else "revisit"
                index.append(f"{len(data)} {len(gz)} {kind} {'-' if page is None else page}")
                data += gz
                if len(data) >= p.package_bytes:
                    yield flush()
        if index:
            yield flush()
    return fn


def write_packages(pages: DataFrame, root: str, params: WarcParams | None = None, id_col: str = "page_id",
                   url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write the packages under ``root`` (an existing shared folder);
    returns (path, records) of each."""
    p = params or WarcParams()
    d = (pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                      F.coalesce(F.col(html_col), F.lit("")).alias("html"))
              .withColumns({"digest": F.sha1("html"), "size": F.octet_length("html")}))
    # one row per payload that occurs on several pages; sums are made before
    # the shuffle, and the join can split a payload with very many pages
    twice = (d.where(F.col("size") >= p.min_revisit).groupBy("digest")
              .agg(F.max("page_id").alias("keep"), F.min("page_id").alias("low"))
              .where("keep != low").select("digest", "keep"))
    refers = F.when((F.col("size") >= p.min_revisit) & (F.col("page_id") != F.col("keep")), F.col("keep"))
    rows = d.join(twice, "digest", "left").select("page_id", "url", "html", "digest", refers.alias("refers"))
    return rows.mapInArrow(_write(root, p), "path string, records bigint").checkpoint()


# ---- reading -------------------------------------------------------------

def central_directory(f, size: int) -> Iterator[dict]:
    """Entries of a ZIP file (name, method, compressed and plain size, local
    header offset) by ranged reads; ZIP64 records are followed."""
    tail_at = max(0, size - 65557)
    tail = f.read_at(size - tail_at, tail_at)
    at = tail.rfind(b"PK\x05\x06")
    if at < 0:
        raise ValueError("no end of central directory")
    entries, length, offset = struct.unpack_from("<HII", tail, at + 10)
    if entries == 0xFFFF or length == 0xFFFFFFFF or offset == 0xFFFFFFFF:
        where = tail_at + at - 20
        loc = f.read_at(20, where) if where >= 0 else b""
        if loc[:4] != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        end = f.read_at(56, struct.unpack_from("<Q", loc, 8)[0])
        if end[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of central directory")
        entries, length, offset = struct.unpack_from("<QQQ", end, 32)
    cd, at = f.read_at(length, offset), 0
    for _ in range(entries):
        if cd[at:at + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        method, = struct.unpack_from("<H", cd, at + 10)
        packed, plain, n, extra, note = struct.unpack_from("<IIHHH", cd, at + 20)
        local, = struct.unpack_from("<I", cd, at + 42)
        name = cd[at + 46:at + 46 + n].decode("utf-8", "replace")
        x, stop = at + 46 + n, at + 46 + n + extra
        while x + 4 <= stop:  # ZIP64 extra field: only the values that overflowed, in this order
            tag, m = struct.unpack_from("<HH", cd, x)
            if tag == 1:
                y = x + 4
                if plain == 0xFFFFFFFF:
                    plain, y = struct.unpack_from("<Q", cd, y)[0], y + 8
                if packed == 0xFFFFFFFF:
                    packed, y = struct.unpack_from("<Q", cd, y)[0], y + 8
                if local == 0xFFFFFFFF:
                    local = struct.unpack_from("<Q", cd, y)[0]
            x += 4 + m
        yield {"name": name, "method": method, "packed": packed, "size": plain, "header": local}
        at = stop + note


def data_offset(f, entry: dict) -> int:
    """Where a stored member's bytes begin."""
    if entry["method"] != 0:
        raise ValueError(f"{entry['name']} is not stored")
    h = f.read_at(30, entry["header"])
    if h[:4] != b"PK\x03\x04":
        raise ValueError("broken local header")
    return entry["header"] + 30 + sum(struct.unpack_from("<HH", h, 26))


def _walk(f, start: int, size: int, step: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """(offset, length) of the gzip members of a stored member."""
    at, begin, gz = 0, 0, zlib.decompressobj(31)
    while at < size:
        data = f.read_at(min(step, size - at), start + at)
        used = 0
        while used < len(data):
            gz.decompress(data[used:])
            if not gz.eof:
                break
            used = len(data) - len(gz.unused_data)
            yield begin, at + used - begin
            begin, gz = at + used, zlib.decompressobj(31)
        at += len(data)


def records_of(f, size: int) -> Iterator[tuple[int, int]]:
    """(file offset, length) of every record in a package."""
    members = {e["name"]: e for e in central_directory(f, size)}
    for name, e in members.items():
        if not name.endswith(".warc.gz"):
            continue
        start = data_offset(f, e)
        if name == DATA and INDEX in members:
            i = members[INDEX]
            for line in f.read_at(i["size"], data_offset(f, i)).decode().splitlines():
                offset, length = line.split(" ")[:2]
                yield start + int(offset), int(length)
        else:
            for offset, length in _walk(f, start, e["size"]):
                yield start + offset, length


def _locate(batches):
    for b in batches:
        for path in b.column(0).to_pylist():
            fs, name = open_fs(path)
            with fs.open_input_file(name) as f:
                at = list(records_of(f, f.size()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([path] * len(at), pa.string()), pa.array([o for o, _ in at], pa.int64()),
                 pa.array([n for _, n in at], pa.int64())], names=["path", "offset", "length"])


_ROW = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]


def _read(batches):
    name, f = None, None
    for b in batches:
        rows = []
        for path, offset, length in zip(*(b.column(i).to_pylist() for i in range(3))):
            if path != name:
                if f is not None:
                    f.close()
                fs, local = open_fs(path)
                name, f = path, fs.open_input_file(local)
            rows.append(parse_record(gzip.decompress(f.read_at(length, offset))))
        yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in _ROW],
                                         names=[n for n, _ in _ROW])
    if f is not None:
        f.close()


def read_packages(packages: DataFrame, params: WarcParams | None = None) -> DataFrame:
    """Records of the packages (path, records)."""
    p = params or WarcParams()
    tasks = max(1, (packages.agg(F.sum("records")).first()[0] or 0) // p.read_rows)
    at = packages.select("path").mapInArrow(_locate, "path string, offset bigint, length bigint")
    # neighbouring records of a package are read by the same task
    run = at.repartition(tasks, "path", F.floor(F.col("offset") / (1 << 20))).sortWithinPartitions("path", "offset")
    return run.mapInArrow(_read, "page_id bigint, url string, payload_bytes bigint, payload_digest string, "
                                 "record_type string, refers_to bigint")
