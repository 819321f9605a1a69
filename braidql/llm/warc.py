"""WARC files: writing captures, reading records, assembling transactions.

A capture is one response (or revisit) record with its request and metadata
records, tied together by ``WARC-Concurrent-To``.  ``write_captures`` writes
them, each record a gzip member of its own, in files of bounded size;
``read_records`` streams files back into one row a record; ``assemble`` joins
the records of a transaction through their concurrent-to identifiers and gives
one nested row for each capture.

Equal payloads of ``min_revisit`` bytes or more are stored once: the record of
the smallest page id is the response, the others are revisits that refer to it.
Which those are is found from digests and ids alone, so a payload that a third
of all pages share is one small aggregate and never a group of payloads.
Record ids are made from page id and digest: a task that runs again writes the
same bytes.

Defined results: a null html is an empty payload; a null url is written as an
empty target and read as null; rows that repeat a page id are captures of their
own, and if their payloads are equal too they are equal records, all responses
if theirs is the smallest id; an empty table writes no file.  A request or metadata record whose
concurrent-to names no capture is left out of the assembly, and listed by
``orphans``.  A chain (metadata to request to response) is followed to its
capture.  Several targets count once for each capture.
"""

from __future__ import annotations

import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import materialize, open_fs, scratch, write_atomically

#: Fixed values of the WARC 1.1 format.
VERSION = b"WARC/1.1\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"

CAPTURES = ("response", "revisit", "resource")
RECORD = (
    "record_id string, record_type string, target_uri string, date string, concurrent_to array<string>, refers_to string,"
    " content_type string, payload_digest string, block_bytes long, payload_bytes long, page_id long, payload_sha256 string, block binary, file string, offset long"
)


def _record(kind: str, record_id: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", DATE), *headers, ("Content-Length", str(len(block)))]
    head = VERSION + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + b"\r\n"
    gz = zlib.compressobj(6, zlib.DEFLATED, 31)
    return gz.compress(head) + gz.compress(block) + gz.compress(b"\r\n\r\n") + gz.flush()


def _urn(*parts: object) -> str:
    return f"urn:uuid:{uuid.UUID(hashlib.md5('|'.join(map(str, parts)).encode()).hexdigest())}"


def _safe(url: str | None) -> str:
    return "".join(c if " " < c != "\x7f" else f"%{ord(c):02X}" for c in url or "")


def capture_records(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> Iterator[bytes]:
    """The records of one capture: request, response or revisit, metadata."""
    target = [("WARC-Target-URI", _safe(url))]
    own = _urn("capture", page_id, digest)
    page = [("X-Page-Id", "" if page_id is None else str(page_id))]
    host = _safe(url).split("://", 1)[-1].split("/", 1)[0]
    request = f"GET {_safe(url) or '/'} HTTP/1.1\r\nHost: {host}\r\n\r\n".encode()
    request_id = _urn("request", page_id, digest)
    yield _record("request", request_id, [*target, ("WARC-Concurrent-To", f"<{own}>"), ("Content-Type", "application/http;msgtype=request")], request)
    sha = [("WARC-Payload-Digest", f"sha256:{digest}")]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    kind = [("Content-Type", "application/http;msgtype=response")]
    if refers_to is None:
        yield _record("response", own, [*target, *page, *sha, *kind], http + payload)
    else:
        yield _record("revisit", own, [*target, *page, *sha, *kind, ("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<{_urn('capture', refers_to, digest)}>")], http)
    meta = f"fetchTimeMs: 0\r\ncharsetForLinkExtraction: utf-8\r\npayloadLength: {len(payload)}\r\n".encode()
    yield _record("metadata", _urn("metadata", page_id, digest), [*target, ("WARC-Concurrent-To", f"<{request_id}>"), ("Content-Type", "application/warc-fields")], meta)


#: A file is closed when it has this many bytes.
FILE_BYTES = 512 << 20


def _writer(path: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        columns = ("page_id", "url", "payload", "digest", "refers_to")
        rows = (tuple(v.as_py() for v in row) for batch in batches for row in zip(*(batch.column(c) for c in columns), strict=True))
        row, count = next(rows, None), 0

        def stream() -> Iterator[bytes]:
            nonlocal row, count
            yield _record("warcinfo", _urn("info", part, number), [("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
            written = 0
            while row is not None and written < FILE_BYTES:
                for record in capture_records(*row):
                    written += len(record)
                    yield record
                row, count = next(rows, None), count + 1

        while row is not None:
            name, count = f"{path}/part-{part:06d}-{number:04d}.warc.gz", 0
            size = write_atomically(name, stream())
            yield pa.RecordBatch.from_pydict({"path": [name], "captures": [count], "bytes": [size]})
            number += 1

    return write


def write_captures(df: DataFrame, path: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit: int = 100) -> DataFrame:
    """Write one capture a row; returns the list of files."""
    path = path or scratch(df.sparkSession, "warc")
    payload = F.coalesce(F.col(html_col).cast("binary"), F.lit(b""))
    pages = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    repeated = (
        pages.filter(F.length("payload") >= min_revisit).groupBy(F.col("digest").alias("of")).agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("of", "first")
    )
    rows = pages.join(repeated, pages["digest"] == repeated["of"], "left").withColumn("refers_to", F.when(F.col("page_id") > F.col("first"), F.col("first")))
    files = rows.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(_writer(path), "path string, captures long, bytes long")
    files.write.parquet(f"{path}/files")
    return df.sparkSession.read.schema("path string, captures long, bytes long").parquet(f"{path}/files")


class _Members:
    """Reads the gzip members (or the plain bytes) of a stream one record at a time."""

    def __init__(self, source, chunk: int = 1 << 18):
        self.source, self.chunk, self.rest, self.at = source, chunk, b"", 0

    def __iter__(self) -> Iterator[tuple[int, bytes]]:
        while self.rest or (more := self.source.read(self.chunk)):
            if not self.rest:
                self.rest = more
            start, gz, out = self.at, zlib.decompressobj(31), []
            while not gz.eof:
                if not self.rest:
                    self.rest = self.source.read(self.chunk)
                    if not self.rest:
                        raise ValueError(f"the record at {start} is cut off")
                out.append(gz.decompress(self.rest))
                used = len(self.rest) - len(gz.unused_data)
                self.at += used
                self.rest = gz.unused_data
            yield start, b"".join(out)


def parse_record(data: bytes) -> tuple[dict[str, list[str]], bytes]:
    """(headers by lower-case name, block) of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not lines[0].startswith(b"WARC/"):
        raise ValueError("no WARC version line")
    headers: dict[str, list[str]] = {}
    last = None
    for line in lines[1:]:
        if line[:1] in b" \t" and last:  # a folded line
            headers[last][-1] += " " + line.strip().decode("utf-8", "replace")
            continue
        name, _, value = line.partition(b":")
        last = name.strip().lower().decode("utf-8", "replace")
        headers.setdefault(last, []).append(value.strip().decode("utf-8", "replace"))
    length = int(headers.get("content-length", ["0"])[0])
    if len(rest) < length:
        raise ValueError("the block is shorter than its Content-Length")
    return headers, rest[:length]


def _bare(value: str | None) -> str | None:
    return value[1:-1] if value and value[:1] == "<" and value[-1:] == ">" else value


def record_row(headers: dict[str, list[str]], block: bytes, keep_block: bool, file: str, offset: int) -> dict:
    one = lambda name: headers.get(name, [None])[0]
    kind = one("warc-type")
    payload = block
    if (one("content-type") or "").startswith("application/http"):
        _, found, body = block.partition(b"\r\n\r\n")
        payload = body if found else b""
    page = one("x-page-id")
    digest, stated = hashlib.sha256(payload).hexdigest() if kind in ("response", "resource") else None, one("warc-payload-digest") or ""
    if digest and stated.lower().startswith("sha256:") and stated[7:].lower() != digest:
        raise ValueError(f"{file}: the record at {offset} holds another payload than its digest says")
    return {
        "record_id": _bare(one("warc-record-id")),
        "record_type": kind,
        "target_uri": one("warc-target-uri") or None,
        "date": one("warc-date"),
        "concurrent_to": [_bare(v) for v in headers.get("warc-concurrent-to", [])],
        "refers_to": _bare(one("warc-refers-to")),
        "content_type": one("content-type"),
        "payload_digest": one("warc-payload-digest"),
        "block_bytes": len(block),
        "payload_bytes": None if kind == "revisit" else len(payload),
        "page_id": int(page) if page else None,
        "payload_sha256": digest,
        "block": block if keep_block else None,
        "file": file,
        "offset": offset,
    }


def _arrow_schema() -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "array<string>": pa.list_(pa.string()), "binary": pa.binary()}
    return pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in RECORD.split(", ")])


def _read(batches: Iterator[pa.RecordBatch], keep_block: bool) -> Iterator[pa.RecordBatch]:
    schema = _arrow_schema()
    for batch in batches:
        for name in batch.column("path").to_pylist():
            fs, path = open_fs(name)
            with fs.open_input_stream(path, compression=None) as source:
                rows, held = [], 0
                for offset, data in _Members(io.BufferedReader(source) if isinstance(source, io.RawIOBase) else source):
                    headers, block = parse_record(data)
                    rows.append(record_row(headers, block, keep_block, name, offset))
                    held += len(block) * keep_block + 500
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)


def read_records(files: DataFrame, keep_block: bool = True) -> DataFrame:
    """One row for each record of the files in column ``path``."""
    n = max(1, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return files.select("path").repartition(n).mapInArrow(lambda it: _read(it, keep_block), RECORD)


def _links(records: DataFrame) -> DataFrame:
    """(record_id, capture): the capture that each other record belongs to.

    Hop by hop: records that name a capture, then records that name those,
    until a hop finds none.  Concurrent-to holds in both directions.
    """
    named = records.select("record_id", "record_type", F.explode("concurrent_to").alias("other")).filter(F.col("other").isNotNull() & F.col("record_id").isNotNull())
    edges = named.select(F.col("record_id").alias("a"), F.col("other").alias("b")).union(named.select(F.col("other").alias("a"), F.col("record_id").alias("b"))).distinct()
    captures = records.filter(F.col("record_type").isin(*CAPTURES)).select(F.col("record_id").alias("id")).distinct()
    edges = materialize(edges.join(captures, edges["a"] == captures["id"], "left_anti"), "warc-edges")
    found = materialize(edges.join(captures, edges["b"] == captures["id"]).select(F.col("a").alias("record_id"), F.col("b").alias("capture")).distinct(), "warc-links")
    newest = found
    while True:
        reached = newest.withColumnsRenamed({"record_id": "via", "capture": "at"})
        step = edges.join(reached, edges["b"] == reached["via"]).select(F.col("a").alias("record_id"), F.col("at").alias("capture")).distinct()
        newest = materialize(step.join(found.select("record_id").distinct(), "record_id", "left_anti"), "warc-links")
        if newest.isEmpty():
            return found
        found = materialize(found.union(newest), "warc-links")


def _agrees(digest: str) -> Column:
    """Whether a record's stated SHA-256, if it states one, is ``digest``, where there is one."""
    stated = F.lower("payload_digest")
    return F.coalesce(~stated.startswith("sha256:") | (F.substring(stated, 8, 64) == F.col(digest)), F.lit(True))


def assemble(records: DataFrame) -> DataFrame:
    """One row for each capture: its record, arrays of requests and metadata, and for a revisit the response it refers to.

    ``payload_sha256`` is computed from the payload that was read, a revisit's
    from that of its response; a record that states another one is an error.
    """
    records = materialize(records, "warc-records")
    links = _links(records)
    inner = F.struct("record_id", "record_type", "target_uri", "date", "content_type", "block_bytes", "block")
    others = records.filter(~F.col("record_type").isin(*CAPTURES)).join(links, "record_id")
    gathered = others.groupBy(F.col("capture").alias("of")).agg(
        F.collect_set(F.when(F.col("record_type") == "request", inner)).alias("requests"),
        F.collect_set(F.when(F.col("record_type") != "request", inner)).alias("metadata"),
    )
    main = records.filter(F.col("record_type").isin(*CAPTURES))
    named = main.filter("refers_to is not null").select(F.col("refers_to").alias("id")).distinct()
    originals = (
        main.join(named, main["record_id"] == named["id"], "left_semi")
        .groupBy(F.col("record_id").alias("original_id"))
        .agg(F.min(F.struct("page_id", "record_id", "payload_bytes", "payload_sha256", "file", "offset")).alias("original"))
    )
    return (
        main.join(gathered, main["record_id"] == gathered["of"], "left")
        .join(originals, main["refers_to"] == originals["original_id"], "left")
        .drop("of", "concurrent_to", "original_id")
        .withColumn("payload_bytes", F.coalesce("payload_bytes", "original.payload_bytes"))
        .withColumn("payload_sha256", F.when(~_agrees("original.payload_sha256"), F.raise_error(F.lit("a revisit's digest is not that of the response it refers to"))).otherwise(F.coalesce("payload_sha256", "original.payload_sha256")))
    )


def orphans(records: DataFrame) -> DataFrame:
    """Request and metadata records that lead to no capture."""
    return records.filter(~F.col("record_type").isin(*CAPTURES, "warcinfo")).join(_links(records), "record_id", "left_anti")
