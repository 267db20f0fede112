"""WARC archives: a writer with payload de-duplication, and a Python data source that reads them.

Every record is a gzip member of its own. The member's header names its compressed length (extra field
"sl"), so a reader can step over a record without inflating it; members of other writers lack the
field and are inflated as they pass.

The data source plans one partition per file. It takes over equality, membership, order and
null predicates on record type, page, target and digest, parses the headers of a record first, and inflates the rest of it only if the
record qualifies and the wanted columns include the payload.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
)

from faretide.llm.token_files import put

# Payloads with fewer bytes are always stored.
LEAST_BYTES = 100
# An archive file is closed when it holds this many bytes.
FILE_BYTES = 32 << 20
LEVEL = 3
SCHEMA = (
    "record_id string, record_type string, page_id long, target_uri string, payload_digest string, "
    "payload_bytes long, refers_to long, payload binary"
)
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CHUNK = 1 << 16


def _member(data: bytes) -> bytes:
    """A gzip member whose header names the lengths of the compressed and the plain data."""
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    size = 10 + 2 + 12 + len(body) + 8
    head = b"\x1f\x8b\x08\x04" + bytes(4) + b"\x00\xff"
    extra = struct.pack("<H2sHII", 12, b"sl", 8, size, len(data) & 0xFFFFFFFF)
    return head + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def _record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    def name(page: int | None) -> str:
        seed = f"page {page}" if page is not None else f"page {url} {digest}"
        return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, seed)}>"

    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers_to is not None else 'response'}",
        f"WARC-Record-ID: {name(page_id)}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        # A line end in an address must not start a header.
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: quote(m[0]), url))
    if page_id is not None:
        lines.append(f"Page-ID: {page_id}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {name(refers_to)}", f"Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join([*lines, "", ""]).encode() + block + b"\r\n\r\n"


def _write(folder: str, file_bytes: int, date: str):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, size, records = TaskContext.get().partitionId(), 0, [], 0, 0

        def close() -> pa.RecordBatch:
            name = f"part-{part:06d}-{number:06d}.warc.gz"
            put(f"{folder}/{name}", b"".join(held))
            return pa.RecordBatch.from_pylist([{"file": name, "records": records, "bytes": size}])

        for batch in batches:
            for page_id, url, html, refers_to in zip(*batch.columns):
                payload = html.as_buffer().to_pybytes() if html.is_valid else b""
                digest = hashlib.sha256(payload).hexdigest()
                member = _member(_record(page_id.as_py(), url.as_py(), payload, digest, refers_to.as_py(), date))
                held.append(member)
                size += len(member)
                records += 1
                if size >= file_bytes:
                    yield close()
                    held, size, records, number = [], 0, 0, number + 1
        if held:
            yield close()

    return build


def write_archives(
    pages: DataFrame,
    folder: str,
    least_bytes: int = LEAST_BYTES,
    file_bytes: int = FILE_BYTES,
    date: str = "1970-01-01T00:00:00Z",
) -> DataFrame:
    """Write ``pages(page_id, url, html)`` to ``folder``; gives ``file, records, bytes`` per file when it is run.

    Of pages with equal payloads of at least ``least_bytes`` bytes, that with the smallest page_id is stored and the
    others refer to it; rows that repeat that page_id are stored too. Rows without page_id are stored. A null html
    is an empty payload; a null url has no address. Other columns are ignored.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    )
    digests = rows.filter(F.octet_length("html") >= least_bytes).select("page_id", F.sha2("html", 256).alias("digest"))
    # A row per payload that occurs more than once, combined before the shuffle.
    first = digests.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last"))
    first = first.filter("refers_to < last").select("digest", "refers_to")
    again = digests.join(first, "digest").filter("page_id > refers_to").distinct()
    # The pages go once through a shuffle at any size.
    chosen = (
        rows.withColumn("digest", F.sha2("html", 256))
        .hint("merge")
        .join(again.select("page_id", "digest", "refers_to"), ["page_id", "digest"], "left")
        .select("page_id", "url", "html", "refers_to")
    )
    return chosen.mapInArrow(_write(folder, file_bytes, date), "file string, records long, bytes long")


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class _Stream:
    """A file read in chunks, with a look ahead."""

    def __init__(self, source):
        self._source, self._held = source, b""

    def need(self, n: int) -> bytes:
        """The next bytes, without taking them; fewer at the end of the file."""
        while len(self._held) < n:
            more = self._source.read(max(_CHUNK, n - len(self._held)))
            if not more:
                break
            self._held += more
        return self._held[:n]

    def take(self, n: int) -> bytes:
        out = self.need(n)
        if len(out) < n:
            raise ValueError("archive file is cut off")
        self._held = self._held[n:]
        return out

    def skip(self, n: int) -> None:
        if n > len(self._held):
            self._source.seek(self._source.tell() + n - len(self._held))
            self._held = b""
        else:
            self._held = self._held[n:]


def _headers(text: bytes) -> dict[str, str]:
    lines = text.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    pairs = (line.partition(":") for line in lines[1:] if line)
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


class _Inflated:
    """The plain data of one gzip member, inflated only as far as asked for."""

    def __init__(self, stream: _Stream):
        self._stream = stream
        head = stream.need(24)
        self._size = None
        if head[3:4] == b"\x04" and head[12:14] == b"sl":
            self._size = struct.unpack_from("<I", head, 16)[0]
        self._raw = stream.take(self._size) if self._size else b""
        self._engine = zlib.decompressobj(31)
        self._out = b""

    def need(self, n: int) -> bytes:
        while len(self._out) < n and not self._engine.eof:
            want = n - len(self._out)
            if self._size:
                self._out += self._engine.decompress(self._engine.unconsumed_tail or self._raw, want)
                self._raw = b""
            else:
                # A member of unknown length: feed it in chunks and give back what lies beyond it.
                chunk = self._engine.unconsumed_tail or self._stream.take(max(1, len(self._stream.need(_CHUNK))))
                self._out += self._engine.decompress(chunk, want)
                if self._engine.eof:
                    self._stream._held = self._engine.unused_data + self._stream._held
        return self._out[:n]

    def close(self) -> None:
        """Leave the stream at the next member; of a member of known length nothing more is inflated."""
        while not self._size and not self._engine.eof:
            self._out = b""
            self.need(_CHUNK)


class _Plain:
    """A record of an uncompressed archive."""

    def __init__(self, stream: _Stream):
        self._stream = stream

    def need(self, n: int) -> bytes:
        return self._stream.need(n)


def _records(source, wanted, with_payload: bool) -> Iterator[tuple[dict[str, str], bytes | None, int | None]]:
    """(headers, payload, payload length) of the records whose headers are ``wanted``."""
    stream = _Stream(source)
    while True:
        packed = stream.need(2) == b"\x1f\x8b"
        if not stream.need(1):
            return
        body = _Inflated(stream) if packed else _Plain(stream)
        n = 2048
        while (end := (text := body.need(n)).find(b"\r\n\r\n")) < 0:
            if len(text) < n:
                raise ValueError("record without end of headers")
            n *= 2
        headers = _headers(text[:end])
        length = int(headers.get("content-length", 0))
        if wanted(headers):
            payload = size = None
            if headers.get("content-type", "").startswith("application/http"):
                # The head of the HTTP message tells the length of the payload also where it is left out.
                n = end + 4 + min(length, 2048)
                while (stop := body.need(n).find(b"\r\n\r\n", end + 4)) < 0 and n < end + 4 + length:
                    n = min(2 * n, end + 4 + length)
                message = body.need(n)[end + 4 :]
                found = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", message)
                size = int(found[1]) if found else max(0, length - (stop + 4 - end - 4)) if stop >= 0 else None
                if with_payload and headers.get("warc-type") != "revisit" and stop >= 0:
                    payload = body.need(end + 4 + length)[stop + 4 :]
            elif with_payload:
                payload = body.need(end + 4 + length)[end + 4 :]
            yield headers, payload, size
        if packed:
            body.close()
        else:
            stream.skip(end + 4 + length)
            while stream.need(1) in (b"\r", b"\n"):
                stream.take(1)


def _whole(value: str | None) -> int | None:
    return int(value) if value is not None and re.fullmatch(r"-?\d+", value) else None


_COLUMNS = {
    "record_id": lambda h: h.get("warc-record-id"),
    "record_type": lambda h: h.get("warc-type"),
    "page_id": lambda h: _whole(h.get("page-id")),
    "target_uri": lambda h: h.get("warc-target-uri"),
    "payload_digest": lambda h: (h.get("warc-payload-digest") or "").removeprefix("sha256:") or None,
    "refers_to": lambda h: _whole(h.get("refers-to-page-id")),
}
_TESTS = {
    EqualTo: lambda x, y: x == y,
    In: lambda x, y: x in y,
    GreaterThan: lambda x, y: x > y,
    GreaterThanOrEqual: lambda x, y: x >= y,
    LessThan: lambda x, y: x < y,
    LessThanOrEqual: lambda x, y: x <= y,
}


class WarcReader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self._path = options["path"]
        self._names = schema.fieldNames()
        self._schema = schema
        self._tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in _COLUMNS and isinstance(f, (IsNull, IsNotNull, *_TESTS)):
                self._tests.append((column, type(f).__name__, getattr(f, "value", None)))
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        where, path = fs.FileSystem.from_uri(self._path)
        found = where.get_file_info(path)
        files = [found] if found.type == fs.FileType.File else where.get_file_info(fs.FileSelector(path))
        names = sorted(f.path for f in files if re.search(r"\.warc(\.gz)?$", f.path))
        return [_File(name) for name in names]

    def _wanted(self, headers: dict[str, str]) -> bool:
        for column, kind, value in self._tests:
            own = _COLUMNS[column](headers)
            if kind in ("IsNull", "IsNotNull"):
                if (own is None) != (kind == "IsNull"):
                    return False
            elif own is None or not next(t for c, t in _TESTS.items() if c.__name__ == kind)(own, value):
                return False
        return True

    def read(self, partition: _File | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a folder without archives
            return
        where, _ = fs.FileSystem.from_uri(self._path)
        kinds = pa.schema([(n, pa.binary() if n == "payload" else pa.int64() if n in ("page_id", "payload_bytes", "refers_to") else pa.string()) for n in self._names])
        rows, size = [], 0
        with where.open_input_file(partition.path) as source:
            for headers, payload, length in _records(source, self._wanted, "payload" in self._names):
                values = {n: f(headers) for n, f in _COLUMNS.items()} | {"payload": payload, "payload_bytes": length}
                rows.append({n: values[n] for n in self._names})
                size += 500 + len(payload or b"")
                if size > 4 << 20:
                    yield pa.RecordBatch.from_pylist(rows, kinds)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, kinds)


class WarcDataSource(DataSource):
    """``spark.read.format("warc").load(folder)``; a schema with fewer columns leaves the rest undecoded."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> WarcReader:
        unknown = set(schema.fieldNames()) - {*_COLUMNS, "payload", "payload_bytes"}
        if unknown:
            raise ValueError(f"WARC records have no columns {sorted(unknown)}")
        return WarcReader(self.options, schema)


def read_archives(spark: SparkSession, folder: str, columns: Sequence[str] | None = None) -> DataFrame:
    """The records of a folder's archives; ``columns`` restricts what is parsed. Filters reach the reader.

    A folder without archives gives no rows. A record without page, address or digest has nulls there.
    """
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("warc")
    if columns is not None:
        kinds = dict(part.strip().split(" ") for part in SCHEMA.split(","))
        reader = reader.schema(", ".join(f"{c} {kinds[c]}" for c in columns))
    return reader.load(folder)


def page_records(spark: SparkSession, folder: str) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of every page in the archives.

    Size and digest of stored payloads are taken from the payload itself, those of revisits from the headers.
    """
    records = read_archives(spark, folder)
    return records.select(
        "page_id",
        F.coalesce(F.octet_length("payload").cast("long"), "payload_bytes").alias("payload_bytes"),
        F.coalesce(F.sha2("payload", 256), "payload_digest").alias("payload_digest"),
        "record_type",
        "refers_to",
    )
