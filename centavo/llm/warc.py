"""WARC archives with a two-level capture index.

Records are gzip members in archive files. Index lines (reversed-host URL key and page id, place, length) are sorted across partitions
and cut into compressed blocks of BLOCK_LINES; each index file ends with a sparse directory (the first key of every block),
and a top level holds one entry an index file. A lookup binary-searches the top level, then a file's directory, range-reads one
block, binary-searches its lines, and range-reads the record. Keys are looked up in sorted order, so a block is read once.

Of equal payloads of at least LEAST_PAYLOAD bytes the smallest page id is the response and the others are revisits; shorter ones
are all responses. Null html: empty payload. Null url: the key of an empty one. Null page ids: a response unless a record with an id has the payload. Rows that repeat a page id and payload are stored each.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, stage, table

LEAST_PAYLOAD, BLOCK_LINES, DATE = 100, 1000, "2024-01-01T00:00:00Z"
#: Bytes of records that one task indexes or reads back.
READ_BYTES = 4 << 20
_PAGES = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
_LINES = pa.schema([("key", pa.string()), ("line", pa.string())])
_TOP = pa.schema([("first", pa.string()), ("file", pa.string()), ("at", pa.int64()), ("size", pa.int64())])


def url_key(url: str | None, page_id: int | None) -> str:
    """Reversed host, path and query, then the page id."""
    try:
        parts = urlsplit(url or "")
        host = ",".join(reversed((parts.hostname or "").split(".")))
    except ValueError:
        return f"{quote(url or '')} {page_id}"
    return f"{quote(host, safe=',')}){quote(parts.path or '/')}{'?' + quote(parts.query, safe='=&') if parts.query else ''} {page_id}"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record as a gzip member."""
    kind, body = "revisit", b""
    if refers_to is None:
        kind, body = "response", b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url}')}>"), ("WARC-Date", DATE), ("WARC-Target-URI", quote(url or "about:blank", safe=":/?#[]@!$&'()*+,;=%~")), ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Page-ID", "" if page_id is None else str(page_id)), ("WARC-Payload-Length", str(len(payload)))]
    if refers_to is not None:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To-Page-ID", str(refers_to))]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(body)))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(text.encode() + body + b"\r\n\r\n") + packer.flush()


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """A record's fields and its payload."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    return fields, body.partition(b"\r\n\r\n")[2]


def revisits(pages: DataFrame) -> DataFrame:
    """(page_id, digest, refers_to) of the records that repeat an earlier payload."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    known = pages.select("page_id", F.sha2(payload, 256).alias("digest"), F.length(payload).alias("n")).where(F.col("n") >= LEAST_PAYLOAD)
    first = known.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("copies")).where("copies > 1 and refers_to is not null").drop("copies")
    return known.join(first, "digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "digest", "refers_to").distinct()


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes the archives; returns the index lines (key, line)."""
    again = stage(revisits(pages), "revisits")  # a table of known size: Spark broadcasts it only if small, else both sides shuffle
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    rows = rows.join(again.select(F.col("page_id").alias("__p"), F.col("digest").alias("__d"), "refers_to"), F.col("page_id").eqNullSafe(F.col("__p")) & (F.col("digest") == F.col("__d")), "left").select("page_id", "url", "payload", "digest", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        path, at = f"{root}/{uuid.uuid4().hex}.warc.gz", 0
        with store.open_output_stream(path, compression=None) as sink:
            for batch in batches:
                keys, lines = [], []
                for row in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "digest", "refers_to")), strict=True):
                    page, url, body, digest, refers = (x.as_py() for x in row)
                    member = record(page, url, body, digest, refers)
                    sink.write(member)
                    keys.append(url_key(url, page))
                    lines.append(json.dumps({"file": path, "at": at, "size": len(member)}))
                    at += len(member)
                yield pa.RecordBatch.from_pydict({"key": keys, "line": lines}, schema=_LINES)

    return stage(rows.mapInArrow(run, "key string, line string"), "index-lines")


def write_index(lines: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> list[tuple[str, str, int, int]]:
    """Writes sorted compressed blocks and their directories; returns the top level: (first key, file, directory's place, size), one entry a file."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        path, at, directory, held = f"{root}/{uuid.uuid4().hex}.cdx", 0, [], []

        def put(sink: pa.NativeFile) -> int:
            block = zlib.compress(json.dumps(held).encode())
            directory.append((held[0][0], at, len(block)))
            sink.write(block)
            held.clear()
            return len(block)

        with store.open_output_stream(path, compression=None) as sink:
            for batch in batches:
                for pair in zip(batch.column("key").to_pylist(), batch.column("line").to_pylist(), strict=True):
                    held.append(pair)
                    if len(held) >= block_lines:
                        at += put(sink)
            if held:
                at += put(sink)
            if not directory:
                return
            last = zlib.compress(json.dumps(directory).encode())
            sink.write(last)
        yield pa.RecordBatch.from_pydict({"first": [directory[0][0]], "file": [path], "at": [at], "size": [len(last)]}, schema=_TOP)

    top = stage(lines.repartitionByRange(read_parts(lines), "key").sortWithinPartitions("key", "line").mapInArrow(run, "first string, file string, at long, size long"), "index-top")
    return sorted((r["first"], r["file"], r["at"], r["size"]) for r in top.collect())


def read_parts(lines: DataFrame) -> int:
    """Partitions that hold READ_BYTES of records each: index lines are small, what they stand for is not."""
    held = lines.agg(F.sum(F.get_json_object("line", "$.size").cast("long"))).first()[0] or 0
    return max(1, -(-held // READ_BYTES))


class Index:
    """Lookups in the two levels; remembers the last directory and block."""

    def __init__(self, store: fs.FileSystem, top: list[tuple[str, str, int, int]]):
        self.store, self.top, self.firsts, self.open, self.last = store, top, [x[0] for x in top], {}, {}

    def read(self, file: str, at: int, size: int) -> bytes:
        if file not in self.open:
            if len(self.open) >= 64:
                self.open.pop(next(iter(self.open))).close()
            self.open[file] = self.store.open_input_file(file)
        return self.open[file].read_at(size, at)

    def _load(self, kind: str, file: str, at: int, size: int) -> list:
        if self.last.get(kind, ("",))[0] != (file, at):
            data = json.loads(zlib.decompress(self.read(file, at, size)))
            self.last[kind] = ((file, at), data, [x[0] for x in data])
        return self.last[kind][1:]

    def find(self, key: str) -> Iterator[dict]:
        """Places of every record with the key. Equal keys lie in one file, perhaps in neighbouring blocks."""
        t = bisect.bisect_right(self.firsts, key) - 1
        if t < 0:
            return
        _, file, at, size = self.top[t]
        directory, firsts = self._load("directory", file, at, size)
        for b in range(max(bisect.bisect_left(firsts, key) - 1, 0), bisect.bisect_right(firsts, key)):
            block, keys = self._load("block", file, directory[b][1], directory[b][2])
            for i in range(bisect.bisect_left(keys, key), bisect.bisect_right(keys, key)):
                yield json.loads(block[i][1])


def read_back(keys: DataFrame, top: list[tuple[str, str, int, int]], folder: str, parts: int = 1) -> DataFrame:
    """keys: (key). A row for every record found, from the archive alone; a response's payload is digested anew."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        index = Index(store, top)
        for batch in batches:
            rows: list[tuple] = []
            for key in batch.column("key").to_pylist():
                for place in index.find(key):
                    fields, payload = parse(index.read(place["file"], place["at"], place["size"]))
                    page = int(fields["WARC-Page-ID"]) if fields["WARC-Page-ID"] else None
                    if fields["WARC-Type"] == "response":
                        rows.append((page, len(payload), hashlib.sha256(payload).hexdigest(), "response", None))
                    else:
                        rows.append((page, int(fields["WARC-Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha256:"), "revisit", int(fields["WARC-Refers-To-Page-ID"])))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_PAGES)], schema=_PAGES)

    return keys.distinct().repartitionByRange(parts, "key").sortWithinPartitions("key").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def page_keys(pages: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"key": [url_key(u, p) for u, p in zip(batch.column("url").to_pylist(), batch.column("page_id").to_pylist(), strict=True)]}, schema=pa.schema([("key", pa.string())]))

    return pages.select("url", "page_id").mapInArrow(run, "key string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    folder = new_path(spark, "warc")
    lines = write_archives(pages, folder)
    return read_back(page_keys(pages), write_index(lines, folder), folder, read_parts(lines))


ORACLE = f"""
with p as (select page_id, strlen(coalesce(html, '')) as n, sha256(coalesce(html, '')) as d from pages),
q as (select *, case when n >= {LEAST_PAYLOAD} then min(page_id) over (partition by d, n >= {LEAST_PAYLOAD}) end as first from p)
select page_id, cast(n as bigint) as payload_bytes, d as payload_digest, case when page_id > first then 'revisit' else 'response' end as record_type,
 case when page_id > first then first end as refers_to from q"""
