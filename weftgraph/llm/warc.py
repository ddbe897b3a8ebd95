"""WARC as a Python data source.

``partitions`` lists the files and packs them, largest first, into balanced task inputs. ``pushFilters``
takes over comparisons of record type and headers, so that a record is judged by its WARC headers alone,
before its payload: in a gzip member only the first bytes are inflated, and when the member names its
length in an "sl" extra field, or the file is plain, the rest of an unwanted record is skipped by a seek.
HTTP headers are parsed next and judged likewise; only then the payload is inflated and decoded.

Files are read through pyarrow's file systems, so paths may be local, ``file://``, ``hdfs://`` or ``s3://``.
"""

from __future__ import annotations

import base64
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition,
    IsNotNull, IsNull, LessThan, LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith,
)

from . import common

SCHEMA = (
    "warc_type string, record_id string, target_uri string, warc_date string, content_type string, content_length long, "
    "headers map<string,string>, http_status int, http_content_type string, payload string, malformed string"
)
_ARROW = pa.schema([
    ("warc_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("warc_date", pa.string()), ("content_type", pa.string()),
    ("content_length", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("http_status", pa.int32()), ("http_content_type", pa.string()), ("payload", pa.string()), ("malformed", pa.string()),
])
_OF_RECORD = {"warc_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "warc_date": "warc-date", "content_type": "content-type"}
_HTTP = ("http_status", "http_content_type")
_CHUNK = 1 << 20
_CONTROL = re.compile(r"[\x00-\x1f\x7f-\x9f\u2028\u2029]")


def _test(f: Filter) -> Callable[[object], bool] | None:
    """The predicate that a pushed filter puts on a value; null meets none but IsNull and null-safe equality."""
    v = getattr(f, "value", None)
    known: dict[type, Callable[[object], bool]] = {
        EqualTo: lambda x: x is not None and x == v,
        EqualNullSafe: lambda x: x == v,
        GreaterThan: lambda x: x is not None and x > v,
        GreaterThanOrEqual: lambda x: x is not None and x >= v,
        LessThan: lambda x: x is not None and x < v,
        LessThanOrEqual: lambda x: x is not None and x <= v,
        In: lambda x: x is not None and x in v,
        IsNotNull: lambda x: x is not None,
        IsNull: lambda x: x is None,
        StringStartsWith: lambda x: x is not None and x.startswith(v),
        StringEndsWith: lambda x: x is not None and x.endswith(v),
        StringContains: lambda x: x is not None and v in x,
    }
    if type(f) is In:
        v = set(f.value)
    return known.get(type(f))


class _Input:
    """Buffered reading and skipping over a seekable file."""

    def __init__(self, file: pa.NativeFile):
        self.file, self.size, self.at, self.buf, self.base = file, file.size(), 0, b"", 0

    def peek(self, n: int) -> bytes:
        off = self.at - self.base
        if not 0 <= off <= len(self.buf) or len(self.buf) - off < n:
            want = max(n, _CHUNK)
            self.file.seek(self.at)
            self.buf, self.base, off = self.file.read(min(want, self.size - self.at)) if self.at < self.size else b"", self.at, 0
        return self.buf[off : off + n]

    def skip(self, n: int) -> None:
        self.at = min(self.size, self.at + n)


class _Plain:
    """The body of one record in a plain file."""

    def __init__(self, src: _Input):
        self.src, self.begin = src, src.at

    def take(self, n: int) -> bytes:
        got = self.src.peek(n)
        self.src.skip(len(got))
        return got

    def until(self, mark: bytes) -> bytes | None:
        n = 4096
        while True:
            got = self.src.peek(n)
            if (i := got.find(mark)) >= 0:
                self.src.skip(i + len(mark))
                return got[: i + len(mark)]
            if len(got) < n:
                return None
            n *= 4

    def finish(self, left: int) -> None:
        self.src.skip(left)
        while self.src.peek(1) in (b"\r", b"\n"):
            self.src.skip(1)
        if (after := self.src.peek(5)) and after != b"WARC/" and after[:2] != b"\x1f\x8b":
            raise ValueError(f"the record at byte {self.begin} doesn't end where it says")


class _Gzip(_Plain):
    """The body of one record that is a gzip member; inflated no further than is asked for."""

    def __init__(self, src: _Input):
        super().__init__(src)
        self.inflate, self.out, self.tail = zlib.decompressobj(31), b"", b""
        head = src.peek(24)
        self.length = None
        if head[3] & 4 and head[12:14] == b"sl" and len(head) >= 24:
            self.length = struct.unpack("<I", head[16:20])[0]

    def more(self, n: int) -> bool:
        while len(self.out) < n:
            if self.inflate.eof:
                return False
            data = self.tail or self.src.peek(min(_CHUNK, max(4096, n)))
            if not self.tail:
                self.src.skip(len(data))
            if not data:
                raise EOFError("a gzip member ends early")
            self.out += self.inflate.decompress(data, max(4096, n - len(self.out)))
            self.tail = self.inflate.unconsumed_tail
        return True

    def take(self, n: int) -> bytes:
        self.more(n)
        got, self.out = self.out[:n], self.out[n:]
        return got

    def until(self, mark: bytes) -> bytes | None:
        n = 1024
        while True:
            whole = not self.more(n)
            if (i := self.out.find(mark)) >= 0:
                got, self.out = self.out[: i + len(mark)], self.out[i + len(mark) :]
                return got
            if whole:
                return None
            n *= 4

    def finish(self, left: int) -> None:
        if self.length is not None:
            self.src.at = min(self.src.size, self.begin + self.length)
            return
        while not self.inflate.eof:
            self.out = b""
            self.more(_CHUNK)
        self.src.at -= len(self.inflate.unused_data)


def _headers(block: bytes) -> dict[str, str]:
    found: dict[str, str] = {}
    last = ""
    for line in block.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:
            found[last] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            found.setdefault(last := name.strip().lower(), value.strip())
    return found


def _text(data: bytes, fields: dict[str, str]) -> str:
    """A body without its transfer and content codings, decoded by its charset; what can't be undone stays as it is."""
    if "chunked" in fields.get("transfer-encoding", "").lower():
        out, at = [], 0
        while (end := data.find(b"\r\n", at)) >= 0:
            size = data[at:end].split(b";")[0].strip()
            if not re.fullmatch(rb"[0-9A-Fa-f]+", size):
                break
            if not (n := int(size, 16)):
                data = b"".join(out)
                break
            out.append(data[end + 2 : end + 2 + n])
            at = end + 2 + n + 2
    coding = fields.get("content-encoding", "").lower().strip()
    if coding in ("gzip", "x-gzip", "deflate"):
        for window in (47, -15):
            try:
                data = zlib.decompressobj(window).decompress(data)
                break
            except zlib.error:
                continue
    charset = re.search(r"charset\s*=\s*[\"']?([\w.:-]+)", fields.get("content-type", ""), re.IGNORECASE)
    try:
        return data.decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        return data.decode("utf-8", "replace")


def _resume(src: _Input, begin: int) -> int:
    """Where the next record after ``begin`` starts: a gzip member that inflates to a record, or a record's first line; else the end."""
    at, held = begin + 1, 1 << 16
    while at < src.size:
        src.at = at
        block = src.peek(held)
        for m in re.finditer(rb"\x1f\x8b\x08|(?<=\r\n\r\n)WARC/\d", block):
            if m[0][:1] == b"W":
                return at + m.start()
            src.at = at + m.start()
            try:
                if zlib.decompressobj(31).decompress(src.peek(1 << 12), 5) == b"WARC/":
                    return at + m.start()
            except zlib.error:
                pass
        if at + len(block) >= src.size:
            break
        at += max(1, len(block) - 16)
    return src.size


def records(file: pa.NativeFile, tests: dict[str, list[Callable[[object], bool]]], payload: bool, mode: str = "PERMISSIVE", wanted: dict[str, str] | None = None, name: str = "") -> Iterator[tuple]:
    """Rows of one file that meet ``tests`` (by column) and have the WARC headers ``wanted``.

    A malformed record is an error under FAILFAST, is passed over under DROPMALFORMED, and else is a row of nulls
    but for ``malformed``; reading goes on with the next record.
    """
    early = {c: t for c, t in tests.items() if c not in _HTTP}
    late = {c: t for c, t in tests.items() if c in _HTTP}
    wanted = wanted or {}
    src = _Input(file)
    while src.at < src.size:
        begin = src.at
        try:
            body = _Gzip(src) if src.peek(2) == b"\x1f\x8b" else _Plain(src)
            head = body.until(b"\r\n\r\n")
            if head is None or not head.startswith(b"WARC/"):
                raise ValueError(f"no record at byte {begin}")
            fields = _headers(head)
            left = length = int(fields.get("content-length", "0"))
            if length < 0:
                raise ValueError(f"a negative length in the record at byte {begin}")
            row: dict[str, object] = {c: fields.get(name) for c, name in _OF_RECORD.items()} | {"content_length": length}
            keep = all(fields.get(h) == v for h, v in wanted.items()) and all(t(row[c]) for c, ts in early.items() for t in ts)
            status = kind = text = None
            http_fields: dict[str, str] = {}
            if keep and (payload or late) and (row["content_type"] or "").startswith("application/http"):
                http = body.until(b"\r\n\r\n")
                if http is None or len(http) > left:
                    raise ValueError(f"no HTTP header in the record at byte {begin}")
                left -= len(http)
                http_fields = _headers(http)
                first = http.split(b"\r\n", 1)[0].split()
                status = int(first[1]) if first[:1] and first[0].startswith(b"HTTP/") and first[1:2] and first[1].isdigit() else None
                kind = http_fields.get("content-type")
            keep = keep and all(t({"http_status": status, "http_content_type": kind}[c]) for c, ts in late.items() for t in ts)
            if keep and payload:
                data = body.take(left)
                if len(data) < left:
                    raise EOFError(f"the record at byte {begin} ends early")
                left, text = 0, _text(data, http_fields)
            body.finish(left)
        except (ValueError, EOFError, zlib.error) as error:
            if mode == "FAILFAST":
                raise
            src.at = _resume(src, begin)
            reason = f"{name}: {error}"
            if mode == "PERMISSIVE" and not wanted and all(t(None) for ts in tests.values() for t in ts):
                yield (*[None] * (len(_ARROW) - 1), reason)
            continue
        if keep:
            yield (*(row[c] for c in _OF_RECORD), length, list(fields.items()), status, kind, text, None)


@dataclass
class _Files(InputPartition):
    paths: tuple[str, ...]

    def __init__(self, paths: tuple[str, ...]):
        super().__init__(paths)
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() != "false"
        self.mode = options.get("mode", "PERMISSIVE").upper()
        self.wanted = {k[7:]: v for k, v in options.items() if k.startswith("header.")}
        self.most = int(options.get("maxpartitionbytes", 64 << 20))
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        columns = {*_OF_RECORD, "content_length", *_HTTP}  # not malformed: a record that is passed over isn't read to its end
        for f in filters:
            if len(getattr(f, "attribute", ())) == 1 and f.attribute[0] in columns and _test(f):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[_Files]:
        system, path = pafs.FileSystem.from_uri(self.path) if "://" in self.path else (pafs.LocalFileSystem(), self.path)
        info = system.get_file_info(path)
        found = [info] if info.is_file else system.get_file_info(pafs.FileSelector(path, recursive=True))
        files = sorted(((f.size, f.path) for f in found if f.is_file and f.base_name.endswith((".warc", ".warc.gz"))), reverse=True)
        n = max(1, -(-sum(s for s, _ in files) // self.most))
        bins: list[tuple[int, list[str]]] = [(0, []) for _ in range(min(n, len(files)))]
        for s, p in files:
            i = min(range(len(bins)), key=lambda k: bins[k][0])
            bins[i] = (bins[i][0] + s, [*bins[i][1], p])
        return [_Files(tuple(b)) for _, b in bins] or [_Files(())]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        system = pafs.FileSystem.from_uri(self.path)[0] if "://" in self.path else pafs.LocalFileSystem()
        tests: dict[str, list[Callable[[object], bool]]] = {}
        for f in self.filters:
            tests.setdefault(f.attribute[0], []).append(_test(f))
        rows: list[tuple] = []
        held = 0
        for path in partition.paths:
            with system.open_input_file(path) as file:
                for row in records(file, tests, self.payload, self.mode, self.wanted, path):
                    rows.append(row)
                    held += 256 + len(row[-2] or "")
                    if held > 8 << 20:
                        yield _batch(rows)
                        rows, held = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


class WarcSource(DataSource):
    """``spark.read.format("warc").load(path)``; options payload (true), mode (PERMISSIVE, DROPMALFORMED or FAILFAST),
    maxPartitionBytes, and ``header.NAME``: the value that a record's WARC header must have, judged before its payload.

    Defined cases: a folder without WARC files gives no rows; headers that a record lacks are null; a
    record of length 0 has the payload ""; chunked, gzip and deflate bodies are undone and read by their charset, UTF-8
    by default, bytes that don't fit as U+FFFD; a malformed or truncated record gives a row of nulls whose column
    ``malformed`` tells its file and place (DROPMALFORMED: none; FAILFAST: an error), unless pushed filters pass it over
    by its headers, and reading goes on with the next record; with payload=false the payload is null, and HTTP fields are null unless a filter asks for them.
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader({k.lower(): v for k, v in self.options.items()})


def read_warc(spark: SparkSession, path: str, **options: str) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").options(**options).load(path)


def member(record: bytes, level: int = 1) -> bytes:
    """One gzip member with its compressed and plain length in an "sl" extra field."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(record) + deflate.flush()
    size = 24 + len(body) + 8
    head = b"\x1f\x8b\x08\x04" + b"\0" * 4 + b"\0\xff" + struct.pack("<H", 12) + b"sl" + struct.pack("<HII", 8, size, len(record) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def record(kind: str, uri: str | None, body: bytes, content_type: str, key: str, date: str = "2020-01-01T00:00:00Z", **extra: str) -> bytes:
    rid = uuid.uuid5(uuid.NAMESPACE_URL, f"{kind}:{key}")
    fields = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:uuid:{rid}>", "WARC-Date": date, "WARC-Target-URI": uri, "Content-Type": content_type, "Content-Length": str(len(body))}
    fields |= {k.replace("_", "-"): v for k, v in extra.items()}
    safe = lambda v: v.replace("\r", "%0D").replace("\n", "%0A")
    head = "WARC/1.1\r\n" + "".join(f"{k}: {safe(v)}\r\n" for k, v in fields.items() if v is not None) + "\r\n"
    return head.encode("utf-8", "replace") + body + b"\r\n\r\n"


def write_warc(pages: DataFrame, path: str) -> int:
    """Writes every page as request, response and metadata records, one file a partition; returns the number of pages.

    A file gets its name only when complete, so that a task that is run again replaces its own output. A null id has
    no header. Of a URL that a header can't hold as it is (control characters, outer blanks), its UTF-8 bytes follow
    in base 64 in the header X-Page-Url.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        system, root = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
        system.create_dir(root, recursive=True)
        name = f"{root}/part-{TaskContext.get().partitionId():05d}.warc.gz"
        n, part = 0, f"{name}.{uuid.uuid4().hex}.tmp"
        with system.open_output_stream(part) as out:
            out.write(member(record("warcinfo", None, b"software: weftgraph\r\n", "application/warc-fields", name.rpartition("/")[2])))
            for batch in batches:
                for i, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    payload, key = (html or "").encode("utf-8", "replace"), str(i)
                    own = {} if i is None else {"X_Page_Id": key}
                    if url is not None and (url != url.strip() or _CONTROL.search(url)):
                        own["X_Page_Url"] = base64.b64encode(url.encode("utf-8", "replace")).decode()
                    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
                    out.write(member(record("request", url, f"GET {_CONTROL.sub('', url or '/')} HTTP/1.1\r\n\r\n".encode("utf-8", "replace"), "application/http; msgtype=request", key, **own)))
                    out.write(member(record("response", url, http + payload, "application/http; msgtype=response", key, **own)))
                    out.write(member(record("metadata", url, b"fetchTimeMs: 1\r\n", "application/warc-fields", key, **own)))
                    n += 1
        system.delete_file(name) if system.get_file_info(name).is_file else None
        system.move(part, name)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    system, root = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
    system.create_dir(root, recursive=True)  # an empty table has no task that would make it
    done = pages.select(F.col("page_id").cast("string"), "url", "html").mapInArrow(write, "n long")
    return done.agg(F.sum("n")).first()[0] or 0


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, written as WARC files in the shared folder and read back by record type and header.

    Rows with null ids, null URLs and any URL come back as they are; null HTML comes back as empty.
    """
    path = common.fresh_path(spark, "warc")
    write_warc(common.table(spark, sf_dir, "pages"), path)
    found = read_warc(spark, path).where(
        (F.col("warc_type") == "response") & F.col("content_type").startswith("application/http") & F.col("http_content_type").startswith("text/html")
    )
    url = F.coalesce(F.unbase64(F.col("headers")["x-page-url"]).cast("string"), F.col("target_uri"))
    return found.select(F.col("headers")["x-page-id"].try_cast("long").alias("page_id"), url.alias("url"), "http_status", F.col("payload").alias("html"))


QUERIES = {"op7_warc": op7_warc}
ORACLES = {"op7_warc": "SELECT page_id, url, 200 AS http_status, coalesce(html, '') AS html FROM pages"}
