"""WARC archives: write, normalise and read back.

``write_archives`` streams records into archives that are one gzip stream each, as many
crawlers leave them. ``normalise`` inflates such a stream once, in chunks, rewrites every
record as a gzip member of its own and writes a sidecar index of their offsets. ``read_back``
goes through the index and can fetch any record without reading what stands before it.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worksrisk.llm import files
from worksrisk.llm.common import named_apart, small_batches
from worksrisk.session import Staging

CHUNK = 1 << 20
LEVEL = 4
LEAST_BYTES = 100          # shorter payloads are never stored as a reference
GZIP = 31                  # zlib's window size with a gzip header
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


# --------------------------------------------------------------------- records
def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str,
           refers_to: int | None) -> bytes:
    """A response record with the payload, or a revisit record that names another one."""
    http = _HTTP % len(payload)
    block = http if refers_to is not None else http + payload
    fields = {"WARC-Type": "response" if refers_to is None else "revisit",
              "WARC-Record-ID": _record_id(page_id, digest),
              "WARC-Date": "1970-01-01T00:00:00Z",
              "WARC-Payload-Digest": f"sha256:{digest}",
              "Payload-Length": len(payload)}
    if url is not None:
        fields["WARC-Target-URI"] = quote(url, safe="!#$%&'()*+,/:;=?@[]~")
    if page_id is not None:
        fields["Page-Id"] = page_id
    if refers_to is not None:
        fields["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        fields["WARC-Refers-To"] = _record_id(refers_to, digest)
        fields["Refers-To-Page-Id"] = refers_to
    fields["Content-Type"] = "application/http;msgtype=response"
    fields["Content-Length"] = len(block)
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items())
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_head(head: bytes) -> dict[str, str]:
    first, *lines = head.decode("utf-8").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {first[:40]!r}")
    fields = (line.split(":", 1) for line in lines if line)
    return {name.strip(): value.strip() for name, value in fields}


class Inflated:
    """Reads a gzip stream's content forwards, whether of one member or of many."""

    def __init__(self, source):
        self.source, self.buffer, self.gzip, self.ended = source, bytearray(), None, False

    def _more(self) -> bool:
        rest = self.gzip.unused_data if self.gzip is not None and self.gzip.eof else b""
        data = rest or self.source.read(CHUNK)
        if not data:
            if self.gzip is not None and not self.gzip.eof:
                raise EOFError("the gzip stream is cut short")
            return False
        if self.gzip is None or self.gzip.eof:
            self.gzip = zlib.decompressobj(GZIP)
        self.buffer += self.gzip.decompress(data)
        return True

    def until(self, mark: bytes) -> bytes | None:
        """Content up to and with the mark; None at the end of the stream."""
        seen = 0
        while (at := self.buffer.find(mark, seen)) < 0:
            seen = max(0, len(self.buffer) - len(mark) + 1)
            if not self._more():
                if self.buffer:
                    raise EOFError("a record is cut short")
                return None
        return self._take(at + len(mark))

    def parts(self, n: int) -> Iterator[bytes]:
        """The next n bytes, in pieces of bounded size."""
        while n:
            if not self.buffer and not self._more():
                raise EOFError("a record is cut short")
            part = self._take(min(n, len(self.buffer), CHUNK))
            n -= len(part)
            if part:
                yield part

    def _take(self, n: int) -> bytes:
        part = bytes(self.buffer[:n])
        del self.buffer[:n]
        return part


def normalise_stream(source, sink, index) -> tuple[int, int]:
    """Rewrite one archive with a gzip member per record; records and bytes written.

    The index gets a JSON line per record: offset, length and the header fields.
    """
    content, n, at = Inflated(source), 0, 0
    while (head := content.until(b"\r\n\r\n")) is not None:
        fields = parse_head(head)
        member, start = zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP), at
        at += _write(sink, member.compress(head))
        for piece in content.parts(int(fields["Content-Length"])):
            at += _write(sink, member.compress(piece))
        if b"".join(content.parts(4)) != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")
        at += _write(sink, member.compress(b"\r\n\r\n") + member.flush())
        index.write(json.dumps({"offset": start, "length": at - start, **fields}).encode() + b"\n")
        n += 1
    return n, at


def _write(sink, data: bytes) -> int:
    if data:
        sink.write(data)
    return len(data)


def read_record(source, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """Header fields and block of one member."""
    source.seek(offset)
    data = zlib.decompress(source.read(length), GZIP)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = parse_head(head)
    return fields, rest[:int(fields["Content-Length"])]


# ----------------------------------------------------------------------- tasks
def _write_task(batches: Iterator[pa.RecordBatch], folder: str):
    name, out, gzip, n = files.new_file(folder, ".warc.gz"), None, None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        if out is None:
            out, gzip = files.open_new(name), zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP)
        for i in range(batch.num_rows):
            page_id, url, payload, digest, refers_to = (
                batch.column(c)[i].as_py() for c in ("page_id", "url", "payload", "digest",
                                                     "refers_to"))
            _write(out, gzip.compress(record(page_id, url, payload, digest, refers_to)))
            n += 1
    if out is not None:
        out.write(gzip.flush())
        out.close()
        yield pa.RecordBatch.from_pydict({"file": [name], "n_records": [n]})


def _normalise_task(batches: Iterator[pa.RecordBatch], folder: str):
    for batch in batches:
        for source_name in batch.column("file").to_pylist():
            name = files.new_file(folder, ".warc.gz")
            with (files.open_stream(source_name) as source, files.open_new(name) as sink,
                  files.open_new(f"{name}.idx") as index):
                n, size = normalise_stream(source, sink, index)
            yield pa.RecordBatch.from_pydict({
                "file": [name], "index_file": [f"{name}.idx"], "n_records": [n], "bytes": [size]})


_BACK = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()),
                   ("payload_digest", pa.string()), ("record_type", pa.string()),
                   ("refers_to", pa.int64()), ("record_offset", pa.int64())])


def _index_lines(source) -> Iterator[dict]:
    rest = b""
    while data := source.read(CHUNK):
        *lines, rest = (rest + data).split(b"\n")
        yield from map(json.loads, lines)


def _row(entry: dict, fields: dict[str, str], block: bytes) -> tuple:
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:")
    page_id, refers_to = fields.get("Page-Id"), fields.get("Refers-To-Page-Id")
    n = int(fields["Payload-Length"])
    if kind == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        if (len(payload), hashlib.sha256(payload).hexdigest()) != (n, digest):
            raise ValueError(f"page {page_id}: the payload is not what its header says")
    return (None if page_id is None else int(page_id), n, digest, kind,
            None if refers_to is None else int(refers_to), entry["offset"])


def _read_task(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        for name, index_name in zip(batch.column("file").to_pylist(),
                                    batch.column("index_file").to_pylist()):
            rows = []
            with files.open_random(name) as source, files.open_stream(index_name) as index:
                for entry in _index_lines(index):
                    fields, block = read_record(source, entry["offset"], entry["length"])
                    rows.append(_row(entry, fields, block))
                    if len(rows) >= 5_000:
                        yield _batch(rows)
                        rows = []
            if rows:
                yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows), _BACK.types)], schema=_BACK)


# ------------------------------------------------------------------- operators
def payload_of(html: Column) -> Column:
    return F.encode(F.coalesce(html, F.lit("")), "UTF-8")


def revisits(pages: DataFrame, stage: Staging) -> DataFrame:
    """``page_id, digest, refers_to`` of pages that revisit another with an equal payload.

    Of pages with equal payloads of at least 100 bytes the one with the smallest page_id is
    the response. Pages with that same id, or none, are responses too. Payloads are compared
    by their SHA-256; equal ones are merged before they are shuffled.
    """
    payload = payload_of(F.col("html"))
    narrow = stage.table("digests", pages.select(
        "page_id", F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("n"))
        .filter((F.col("n") >= LEAST_BYTES) & F.col("page_id").isNotNull()).drop("n"))
    first = narrow.groupBy("digest").agg(
        F.min("page_id").alias("refers_to"), F.max("page_id").alias("_last")).filter(
        F.col("_last") > F.col("refers_to")).drop("_last")
    found = narrow.join(first, "digest").filter(F.col("page_id") > F.col("refers_to"))
    return stage.table("revisits", found.select("page_id", "digest", "refers_to").distinct())


def write_archives(pages: DataFrame, stage: Staging) -> DataFrame:
    """Write a record per row of ``pages`` (``page_id, url, html``); ``file, n_records``.

    Null html is an empty payload, a null url leaves its header out. Repeated rows give
    repeated records. Each task writes one archive, a single gzip stream.
    """
    small_batches(pages.sparkSession)
    payload = payload_of(F.col("html"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url",
                        payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    rows = named_apart(rows, revisits(pages, stage), ["page_id", "digest"])
    target = files.folder(stage, "whole")
    return stage.table("written", rows.mapInArrow(
        lambda it: _write_task(it, target), "file string, n_records long"))


def normalise(archives: DataFrame, stage: Staging) -> DataFrame:
    """Rewrite archives (``file``) record by record; ``file, index_file, n_records, bytes``."""
    target = files.folder(stage, "members")
    names = archives.select("file")
    return stage.table("normalised", files.one_task_each(names, names.count()).mapInArrow(
        lambda it: _normalise_task(it, target),
        "file string, index_file string, n_records long, bytes long"))


def read_back(archives: DataFrame) -> DataFrame:
    """One row per record of normalised archives, read through their index and verified.

    ``page_id, payload_bytes, payload_digest, record_type, refers_to, record_offset``. A
    response's payload is compared with its header; a revisit's values are its header's.
    """
    names = archives.select("file", "index_file")
    return files.one_task_each(names, names.count()).mapInArrow(
        _read_task, "page_id long, payload_bytes long, payload_digest string, "
                    "record_type string, refers_to long, record_offset long")
