"""WARC archives: a writer for page tables and a Python data source that reads them back.

The writer stores one gzip member per record and notes each member's compressed length in its gzip extra field.  The
reader parses a record's headers first, tests the pushed predicates on them, and seeks past the members that it
doesn't want, so that their payloads are never inflated.
"""

from __future__ import annotations

import hashlib
import json
import posixpath
import re
import struct
import zlib
from collections.abc import Iterator
from typing import Any, BinaryIO

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith

from .common import cut, fresh_key, map_arrow, sent, ship, text_or_empty, work_dir

#: Smaller payloads are never revisits.
REVISIT_BYTES = 100
#: A file is closed once it has so many bytes, and files are read together up to so many.
FILE_BYTES = 256 << 20
SPLIT_BYTES = 64 << 20
#: Bytes that are fetched to parse a record's headers.
_HEAD_BYTES = 4096
#: Up to so many repeated digests are sent to the scan, about 100 bytes each; beyond, payloads are joined with them by key.
BROADCAST_DIGESTS = 300_000
_EXTRA_ID = b"LS"
_DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

SCHEMA = "file string, record_offset long, record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_length long, headers map<string,string>, payload_bytes long, payload_sha256 string, payload binary"
_ARROW = pa.schema([("file", pa.string()), ("record_offset", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_length", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("payload", pa.binary())])
#: Columns that come straight from a header.
_HEADERS = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest"}


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _line(value: object) -> str:
    """A header value on one line: control characters are percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", str(value))


def record_bytes(headers: dict[str, object], block: bytes) -> bytes:
    head = "".join(f"{k}: {_line(v)}\r\n" for k, v in headers.items() if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + f"Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def gzip_member(record: bytes, level: int = 6) -> bytes:
    """One gzip member whose extra field holds its own length."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(record) + packer.flush()
    size = 10 + 2 + 4 + 8 + len(body) + 8
    extra = _EXTRA_ID + struct.pack("<HQ", 8, size)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def page_record(page_id: int | None, url: str | None, payload: bytes | None, digest: str, length: int, refers_to: int | None) -> bytes:
    """A response record, or a revisit of page ``refers_to``, which has no payload of its own."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    headers = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<urn:page:{'none' if page_id is None else page_id}>",
        "WARC-Date": _DATE,
        "WARC-Target-URI": url,
        "WARC-Payload-Digest": f"sha256:{digest}",
        "X-Payload-Length": length,
        "Content-Type": "application/http; msgtype=response",
    }
    if refers_to is not None:
        headers |= {"WARC-Profile": _PROFILE, "WARC-Refers-To": f"<urn:page:{refers_to}>"}
    return record_bytes(headers, http + (payload or b"" if refers_to is None else b""))


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, payload, digest, length, refers_to): what the writer stores of each page.

    Null html is an empty payload.  Of equal payloads of REVISIT_BYTES or more, the page with the least id is the response
    and the others refer to it; pages with a null id, and rows that repeat the response's id, are responses too.  Payloads
    stay in the scan's tasks as long as there are BROADCAST_DIGESTS repeated digests or fewer.
    """
    payload = text_or_empty(html_col).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("length", F.octet_length("payload").cast("long"))
    first = rows.filter(F.col("length") >= REVISIT_BYTES).groupBy("digest").agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    first = cut(first.select(fresh_key(F.col("digest")).alias("_k"), F.col("digest").alias("_digest"), "_first"))
    joined = rows.withColumn("_k", fresh_key(F.col("digest"))).join(sent(first, BROADCAST_DIGESTS), "_k", "left")
    revisit = (F.col("digest") == F.col("_digest")) & (F.col("page_id") != F.col("_first"))
    return joined.select("page_id", "url", "payload", "digest", "length", F.when(revisit, F.col("_first")).alias("refers_to"))


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", split_bytes: int = SPLIT_BYTES) -> str:
    """Writes archives of all pages into ``folder`` and returns the path of their manifest.

    Each task attempt writes files of its own name; the manifest lists those of the attempts that ended, so
    the remains of a lost executor are never read.  It also has the place of a record every ``split_bytes`` of a file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        stem = f"part-{context.partitionId():06d}-{context.taskAttemptId()}"
        fs, base = _filesystem(folder)
        made: list[dict] = []
        out, path, marks = None, "", []
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    path, marks = posixpath.join(base, f"{stem}-{len(made)}.warc.gz"), [0]
                    out = fs.open_output_stream(path, compression=None)
                    out.write(gzip_member(record_bytes({"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:file:{posixpath.basename(path)}>", "WARC-Date": _DATE, "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n")))
                if out.tell() - marks[-1] >= split_bytes:
                    marks.append(out.tell())
                out.write(gzip_member(page_record(**row)))
                if out.tell() >= FILE_BYTES:
                    made.append({"file": posixpath.basename(path), "bytes": out.tell(), "marks": marks})
                    out.close()
                    out = None
        if out is not None:
            made.append({"file": posixpath.basename(path), "bytes": out.tell(), "marks": marks})
            out.close()
        if made:
            yield pa.RecordBatch.from_pylist(made)

    fs, base = _filesystem(folder)
    fs.create_dir(base, recursive=True)
    records = plan_records(pages, id_col, url_col, html_col)
    files = [r.asDict() for r in map_arrow(records, run, "file string, bytes long, marks array<long>").collect()]
    with fs.open_output_stream(posixpath.join(base, "manifest.json")) as out:
        out.write(json.dumps(sorted(files, key=lambda f: f["file"])).encode())
    return posixpath.join(folder, "manifest.json")


class _Gzip:
    """Inflates one member from a seekable file; ``size`` is its compressed length where its extra field has it."""

    def __init__(self, f: BinaryIO, offset: int) -> None:
        f.seek(offset)
        self.f, self.offset = f, offset
        first = f.read(_HEAD_BYTES)
        self.size = None
        if len(first) >= 24 and first[3] & 4 and first[12:14] == _EXTRA_ID:
            self.size = struct.unpack_from("<Q", first, 16)[0]
        self.packed = zlib.decompressobj(31)
        self.given, self.done = len(first), not first
        self.pending = first

    def read(self, most: int) -> bytes:
        """Up to ``most`` more bytes; empty at the member's end."""
        while not self.packed.eof:
            if not self.pending:
                self.pending = self.f.read(1 << 16)
                self.given += len(self.pending)
                if not self.pending:
                    raise ValueError(f"gzip member at {self.offset} ends early")
            out = self.packed.decompress(self.pending, most)
            self.pending = self.packed.unconsumed_tail
            if out:
                return out
        return b""

    def end(self) -> int:
        """Where the next member begins."""
        if self.size is not None:
            return self.offset + self.size
        while self.read(1 << 20):
            pass
        return self.offset + self.given - len(self.packed.unused_data)


class _Plain:
    """The same over a file that isn't compressed; what comes after the record is read by nobody."""

    def __init__(self, f: BinaryIO, offset: int) -> None:
        f.seek(offset)
        self.f = f

    def read(self, most: int) -> bytes:
        return self.f.read(most)


def read_records(f: BinaryIO, compressed: bool, wanted, content: str, start: int = 0, end: int | None = None) -> Iterator[tuple[int, dict[str, str], bytes | None, int | None, str | None]]:
    """(offset, headers, payload, payload's length, payload's sha256) of the records whose headers ``wanted`` accepts.

    content: none (headers only), digest (length and sha256), payload (also the bytes).  The payload of an
    http record is what follows the http header; a revisit has none.  ``start`` is the place of a record; those that begin
    at ``end`` or later are left to others.
    """
    offset = start
    while end is None or offset < end:
        source = _Gzip(f, offset) if compressed else _Plain(f, offset)
        head = b""
        while b"\r\n\r\n" not in head:
            more = source.read(_HEAD_BYTES) if not (compressed and source.done) else b""
            if not more:
                break
            head += more
        if not head.strip():
            return
        text, found, rest = head.partition(b"\r\n\r\n")
        lines = text.decode("utf-8", "replace").split("\r\n")
        if not found or not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at {offset}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        length = int(headers["content-length"])
        if wanted(headers):
            payload = size = digest = None
            if content != "none":
                block = bytearray(rest[:length])
                while len(block) < length:
                    more = source.read(length - len(block))
                    if not more:
                        raise ValueError(f"record at {offset} ends early")
                    block += more
                body = bytes(block)
                if headers.get("content-type", "").startswith("application/http"):
                    body = body.partition(b"\r\n\r\n")[2]
                if headers.get("warc-type") != "revisit":
                    size, digest = len(body), hashlib.sha256(body).hexdigest()
                    payload = body if content == "payload" else None
            yield offset, headers, payload, size, digest
        offset = source.end() if compressed else offset + len(text) + 4 + length + 4


class _Spans(InputPartition):
    """Runs of records: (path, place of the first, place of the first after them or None for the file's end)."""

    def __init__(self, spans: list[tuple[str, int, int | None]]) -> None:
        super().__init__(0)
        self.spans = spans


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.content = options.get("content", "payload").lower()
        self.split_bytes = int(options.get("split_bytes", SPLIT_BYTES))
        self.tests: list[tuple[str, str, Any]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes tests of header columns; the rest goes back to Spark."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in _HEADERS and isinstance(f, EqualTo):
                self.tests.append((_HEADERS[name], "in", [f.value]))
            elif name in _HEADERS and isinstance(f, In):
                self.tests.append((_HEADERS[name], "in", list(f.value)))
            elif name in _HEADERS and isinstance(f, StringStartsWith):
                self.tests.append((_HEADERS[name], "starts", f.value))
            elif name in _HEADERS and isinstance(f, IsNotNull):
                self.tests.append((_HEADERS[name], "present", None))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        """Runs of about ``split_bytes``: spans of a manifest's files, or whole files of a folder or single path.

        A file without a manifest has to be read from its begin, as nothing tells where its records are.
        """
        fs, base = _filesystem(self.path)
        prefix = self.path[: len(self.path) - len(base)] if self.path.endswith(base) else ""
        spans: list[tuple[str, int, int | None, int]] = []
        if base.endswith("manifest.json"):
            with fs.open_input_stream(base) as f:
                for x in json.loads(f.read()):
                    path, marks = posixpath.join(posixpath.dirname(base), x["file"]), [*x.get("marks", [0]), x["bytes"]]
                    spans += [(path, a, b, b - a) for a, b in zip(marks, marks[1:])]
        elif fs.get_file_info(base).type == pafs.FileType.Directory:
            spans = sorted((x.path, 0, None, x.size) for x in fs.get_file_info(pafs.FileSelector(base)) if re.search(r"\.warc(\.gz)?$", x.path))
        else:
            spans = [(base, 0, None, fs.get_file_info(base).size)]
        parts, held, size = [], [], 0
        for path, a, b, n in spans:
            if held and size + n > self.split_bytes * 5 // 4:
                parts.append(_Spans(held))
                held, size = [], 0
            held.append((prefix + path, a, b))
            size += n
        return [*parts, *([_Spans(held)] if held or not parts else [])]

    def _wanted(self, headers: dict[str, str]) -> bool:
        for name, kind, value in self.tests:
            has = headers.get(name)
            if has is None or kind == "in" and has not in value or kind == "starts" and not has.startswith(value):
                return False
        return True

    def read(self, partition: _Spans) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for path, start, end in partition.spans:
            fs, base = _filesystem(path)
            with fs.open_input_file(base) as f:
                for offset, h, payload, n, digest in read_records(f, base.endswith(".gz"), self._wanted, self.content, start, end):
                    own = {c: h.get(k) for c, k in _HEADERS.items()}
                    length = h.get("x-payload-length")
                    rows.append({"file": path, "record_offset": offset, **own, "payload_length": int(length) if length else None, "headers": list(h.items()), "payload_bytes": n, "payload_sha256": digest, "payload": payload})
                    size += 1000 + len(payload or b"")
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, _ARROW)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _ARROW)


class WarcDataSource(DataSource):
    """``spark.read.format("warc").option("path", ...)``; options content: none, digest or payload (the default); split_bytes."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: Any) -> WarcReader:
        return WarcReader(dict(self.options))


def read_warc(spark: SparkSession, path: str, content: str = "payload", split_bytes: int = SPLIT_BYTES) -> DataFrame:
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)
    return spark.read.format("warc").option("path", path).option("content", content).option("split_bytes", str(split_bytes)).load()


def round_trip(pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) as read back from archives of ``pages``.

    Length and digest of a response are those of the payload that was read, and of a revisit those its headers give.
    An empty table gives no rows.
    """
    spark = pages.sparkSession
    manifest = write_warc(pages, work_dir(spark, "warc"))
    records = read_warc(spark, manifest, "digest").filter(F.col("record_type").isin("response", "revisit"))
    page = lambda c: F.nullif(F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1), F.lit("")).cast("long")
    return records.select(
        page("record_id").alias("page_id"),
        F.coalesce("payload_bytes", "payload_length").alias("payload_bytes"),
        F.coalesce("payload_sha256", F.regexp_replace("payload_digest", "^sha256:", "")).alias("payload_digest"),
        "record_type",
        page("refers_to").alias("refers_to"),
    )
