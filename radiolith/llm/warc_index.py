"""WARC archives with a two-level capture index.

Archives hold one gzip member a record; a record whose payload stands elsewhere already is a revisit, and
carries headers alone. The index has two levels: captures sorted by key (the URL with its host reversed) are
packed into compressed blocks of ``BLOCK`` lines, and a sparse directory keeps the first key of each block
with the block's place. The directory is as many sorted files as tasks wrote index files; a short list names each with
its first key. A lookup finds file and block by binary search, reads the block's range, finds the capture by binary
search in the block, and reads the record's range. No one holds the whole directory.

Files get names of their own from each task; only those that a written manifest names count, so lost
executors and second attempts do no harm.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, filesystem, materialize, scratch, shuffle_width

BLOCK = 512
FILE_BYTES = 64 << 20
SALTS = 64
LEVEL = 3
#: Blocks and records that a task keeps at hand.
KEPT = 64


def capture_key(url: str | None) -> str:
    """The URL's key: host labels reversed and comma-joined, port, ``)``, path and query; lower-case host, no scheme or ``www.``."""
    if not url:
        return ""
    try:
        parts = urlsplit(url if "://" in url else "http://" + url)
        host, port = (parts.hostname or "").removeprefix("www."), parts.port
    except ValueError:
        return url
    port = "" if port in (None, 80, 443) else f":{port}"
    return ",".join(reversed(host.split("."))) + port + ")" + (parts.path or "/") + ("?" + parts.query if parts.query else "")


def payload_digest(payload: bytes) -> str:
    """Upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()  # noqa: S324


def _line(text: str | None) -> str:
    return (text or "").replace("\r", "%0D").replace("\n", "%0A")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None, first_url: str | None, length: int) -> bytes:
    """One gzip member; ``first`` is the page whose payload a revisit stands for, else None."""
    body = b"" if first is not None else payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if first is not None else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {_line(url)}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: text/html; charset=utf-8"]
    if first is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{first}>", f"WARC-Refers-To-Target-URI: {_line(first_url)}"]
    head += [f"Content-Length: {len(body)}", "", ""]
    engine = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return engine.compress("\r\n".join(head).encode() + body + b"\r\n\r\n") + engine.flush()


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and body of an inflated record; ``ValueError`` if it is broken."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not gap or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    size = int(fields["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("broken WARC record")
    return fields, rest[:size]


def _page(urn: str) -> int | None:
    digits = urn[len("<urn:page:") : -1]
    return int(digits) if digits else None


def stream(source) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """``(offset, length, headers, body)`` of each record of an archive, one member in memory at a time."""
    engine, parts, at, used = zlib.decompressobj(31), [], 0, 0
    pending = source.read(1 << 20)
    while pending:
        parts.append(engine.decompress(pending))
        if engine.eof:
            rest = engine.unused_data
            used += len(pending) - len(rest)
            yield at, used, *parse(b"".join(parts))
            at, used, parts, engine, pending = at + used, 0, [], zlib.decompressobj(31), rest
        else:
            used += len(pending)
            pending = b""
        pending = pending or source.read(1 << 20)
    if parts:
        raise ValueError("the archive ends within a record")


_CAPTURE = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])


def write_archives(pages: DataFrame, out: str, least: int = 0) -> DataFrame:
    """Write the archives of ``pages(page_id, url, html)`` below ``out``; returns the captures ``(key, page_id, path, offset, length)``.

    Of equal payloads of ``least`` bytes or more the one with the smallest page_id is written, null ids last.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html")).withColumn("sha", F.sha1(F.col("html")))
    first = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url")).alias("f")
    groups = own.where(F.octet_length("html") >= least).groupBy("sha").agg(F.count("*").alias("n"), first).where("n > 1")
    groups = materialize(groups.select(F.col("sha").alias("s"), F.col("f.page_id").alias("first"), F.col("f.url").alias("first_url"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")), "warc-groups")
    met = own.withColumn("x", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    met = met.join(groups, (met["sha"] == groups["s"]) & (met["x"] == groups["salt"]), "left").select("page_id", "url", "html", "first", "first_url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(out)
        fs.create_dir(root, recursive=True)
        sink, path, size = None, "", 0
        for b in batches:
            rows: list[list] = [[] for _ in _CAPTURE]
            for page_id, url, html, first, first_url in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if sink is None:
                    path, size = f"{root}/{uuid.uuid4().hex}.warc.gz", 0
                    sink = fs.open_output_stream(path, compression=None)
                payload = html.encode()
                raw = record(page_id, url, payload, payload_digest(payload), None if first == page_id else first, first_url, len(payload))
                sink.write(raw)
                for col, v in zip(rows, (capture_key(_line(url)), page_id, path, size, len(raw)), strict=True):
                    col.append(v)
                size += len(raw)
                if size >= FILE_BYTES:
                    sink.close()
                    sink = None
            yield batch(_CAPTURE, rows)
        if sink is not None:
            sink.close()

    return materialize(met.mapInArrow(run, "key string, page_id long, path string, offset long, length long"), "warc-captures")


_DIRECTORY = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("offset", pa.int64()), ("length", pa.int64())])
_PARTS = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("directory", pa.string()), ("path", pa.string())])


def build_index(captures: DataFrame, out: str) -> DataFrame:
    """Write index blocks of ``BLOCK`` captures and their directories below ``out``; returns ``(key, page_id, directory, path)``, one row a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(out)
        fs.create_dir(root, recursive=True)
        path, sink, at = f"{root}/{uuid.uuid4().hex}.cdx.gz", None, 0
        held: list[tuple] = []
        rows: list[list] = [[] for _ in _DIRECTORY]

        def close() -> None:
            nonlocal sink, at
            if sink is None:
                sink = fs.open_output_stream(path, compression=None)
            raw = zlib.compress("\n".join(json.dumps(x) for x in held).encode(), 6)
            sink.write(raw)
            for col, v in zip(rows, (held[0][0], held[0][1], at, len(raw)), strict=True):
                col.append(v)
            at += len(raw)
            held.clear()

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held.append(row)
                if len(held) == BLOCK:
                    close()
        if held:
            close()
        if sink is not None:
            sink.close()
            with pa.ipc.new_file(fs.open_output_stream(f"{path}.directory"), _DIRECTORY) as directory:
                directory.write_batch(batch(_DIRECTORY, rows))
            yield batch(_PARTS, [[rows[0][0]], [rows[1][0]], [f"{path}.directory"], [path]])

    rows = captures.select("key", "page_id", "path", "offset", "length").where("page_id is not null").repartitionByRange(shuffle_width(captures.sparkSession), "key", "page_id").sortWithinPartitions("key", "page_id")
    return materialize(rows.mapInArrow(run, "key string, page_id long, directory string, path string"), "warc-directory")


def save_directory(parts: DataFrame, out: str) -> str:
    """Write the list of the directory's files, a row a task of :func:`build_index`, in order."""
    fs, root = filesystem(out)
    fs.create_dir(root, recursive=True)
    path = f"{root}/{uuid.uuid4().hex}.directories"
    rows = [tuple(r) for r in parts.orderBy("key", "page_id").collect()]
    with pa.ipc.new_file(fs.open_output_stream(path), _PARTS) as sink:
        sink.write_batch(batch(_PARTS, [list(x) for x in zip(*rows, strict=True)] if rows else [[] for _ in _PARTS]))
    return path


class _Entries:
    """A sorted file of keys and ids as a sequence of ``(key, page_id)``, with what stands beside them."""

    def __init__(self, fs, path: str) -> None:
        self.table = pa.ipc.open_file(fs.open_input_file(path)).read_all().combine_chunks()
        self.keys, self.ids = self.table.column(0), self.table.column(1)

    def __len__(self) -> int:
        return self.table.num_rows

    def __getitem__(self, i: int) -> tuple[str, int]:
        return self.keys[i].as_py(), self.ids[i].as_py()

    def place(self, i: int) -> tuple:
        return tuple(self.table.column(k)[i].as_py() for k in (2, 3))


class _Kept(OrderedDict):
    def remember(self, key, value):
        self[key] = value
        while len(self) > KEPT:
            self.popitem(last=False)
        return value


class IndexReader:
    """Lookups in an index; one for each task."""

    def __init__(self, directory: str, root: str) -> None:
        self.fs, _ = filesystem(root)
        self.parts, self.entries, self.blocks, self.records, self.open = _Entries(self.fs, directory), _Kept(), _Kept(), _Kept(), _Kept()

    def _file(self, path: str):
        return self.open[path] if path in self.open else self.open.remember(path, self.fs.open_input_file(path))

    def _block(self, path: str, offset: int, length: int) -> list:
        if (path, offset) not in self.blocks:
            lines = zlib.decompress(self._file(path).read_at(length, offset)).decode().split("\n")
            self.blocks.remember((path, offset), [json.loads(x) for x in lines])
        return self.blocks[path, offset]

    def _blocks(self, low: tuple[str, int]) -> Iterator[tuple[str, tuple[str, int, int]]]:
        """First key and place of each block from the one that can hold ``low`` on."""
        for f in range(max(0, bisect.bisect_right(self.parts, low) - 1), len(self.parts)):
            directory, path = self.parts.place(f)
            own = self.entries[directory] if directory in self.entries else self.entries.remember(directory, _Entries(self.fs, directory))
            for i in range(max(0, bisect.bisect_right(own, low) - 1), len(own)):
                yield own[i][0], (path, *own.place(i))

    def captures(self, key: str, page_id: int | None = None) -> Iterator[tuple[int, str, int, int]]:
        """``(page_id, path, offset, length)`` of the captures with a key, all or that of one page."""
        low = (key, -(1 << 63) if page_id is None else page_id)
        for first, place in self._blocks(low):
            if first > key:
                return
            lines = self._block(*place)
            for k, p, path, offset, length in lines[bisect.bisect_left(lines, list(low), key=lambda x: x[:2]) :]:
                if k != key or (page_id is not None and p != page_id):
                    return
                yield p, path, offset, length

    def read(self, path: str, offset: int, length: int) -> tuple[dict[str, str], bytes]:
        """The record at a place, by one range read."""
        at = (path, offset)
        if at not in self.records:
            self.records.remember(at, parse(zlib.decompress(self._file(path).read_at(length, offset), 31)))
        return self.records[at]


def read_archives(spark: SparkSession, captures: DataFrame, directory: str, root: str) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to)`` of each record of the archives.

    Length and digest are taken from the payload read: a revisit's is that of the record which the index finds
    for it. A digest that differs from the header's raises ``ValueError``.
    """
    files = captures.select("path").distinct()
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, found = IndexReader(directory, root), _Kept()

        def resolve(fields: dict[str, str]) -> tuple[int, str, int]:
            target = _page(fields["WARC-Refers-To"])
            if target not in found:
                for _, *place in index.captures(capture_key(fields["WARC-Refers-To-Target-URI"]), target):
                    head, body = index.read(*place)
                    if head["WARC-Type"] == "response":
                        found.remember(target, (len(body), payload_digest(body), _page(head["WARC-Record-ID"])))
                        break
                else:
                    raise ValueError(f"the index has no response of page {target}")
            return found[target]

        for b in batches:
            for path in b.column(0).to_pylist():
                rows: list[list] = [[] for _ in schema]
                with index.fs.open_input_stream(path, compression=None) as source:
                    for _, _, fields, body in stream(source):
                        kind, refers = fields["WARC-Type"], None
                        if kind == "revisit":
                            size, digest, refers = resolve(fields)
                        else:
                            size, digest = len(body), payload_digest(body)
                        if fields["WARC-Payload-Digest"] != f"sha1:{digest}":
                            raise ValueError("a payload differs from its digest")
                        for col, v in zip(rows, (_page(fields["WARC-Record-ID"]), size, digest, kind, refers), strict=True):
                            col.append(v)
                yield batch(schema, rows)

    return files.repartition(shuffle_width(spark)).mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def lookup(spark: SparkSession, urls: DataFrame, directory: str, root: str, url_col: str = "url") -> DataFrame:
    """``(url, page_id, path, offset, length)`` of the captures of each URL, through the index. URLs are sorted first, so that a task's lookups share blocks."""
    schema = pa.schema([("url", pa.string()), ("page_id", pa.int64()), ("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = IndexReader(directory, root)
        for b in batches:
            rows: list[list] = [[] for _ in schema]
            for url in sorted(b.column(0).to_pylist(), key=lambda u: capture_key(_line(u))):
                for found in index.captures(capture_key(_line(url))):
                    for col, v in zip(rows, (url, *found), strict=True):
                        col.append(v)
            yield batch(schema, rows)

    own = urls.select(F.col(url_col).cast("string").alias("url"))
    return own.repartitionByRange(shuffle_width(spark), "url").mapInArrow(run, "url string, page_id long, path string, offset long, length long")


def archive_pages(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write ``pages(page_id, url, html)`` as WARC with an index, and read the archives back: see :func:`read_archives`.

    A null html is an empty payload, a null url an empty key. Of equal payloads of ``least`` bytes or more
    all but those of the smallest page_id are revisits; rows that repeat that id are responses too. Rows with
    a null id are responses (nothing else could be told of them) if all their group's ids are null, else revisits; they
    are archived but not indexed. Other columns are not read. An empty table gives no rows.
    """
    spark = pages.sparkSession
    root = scratch(spark, "warc")
    captures = write_archives(pages, root, least)
    directory = save_directory(build_index(captures, root), root)
    return read_archives(spark, captures, directory, root)
