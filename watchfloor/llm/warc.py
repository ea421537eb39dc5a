"""WARC archives: writing, normalising monolithic gzip files, reading by sidecar index.

A crawler may compress a whole archive as one gzip stream; then no record can be reached without inflating all before it.
The normaliser inflates such a stream once, chunk by chunk, writes each record as a gzip member of its own and a sidecar index
of (offset, length, type, record id), one line per member. Readers then take ranges of members, so a large archive is
read by many tasks. Archives that are in members already pass through the same way.

Files live below a folder that all executors reach and are written through pyarrow's file systems (local, HDFS, S3, GCS
URIs). Each attempt of a task writes names of its own; only the attempt that Spark counts gets into the manifest, which
is checkpointed, so lost executors and speculative attempts leave at most unread files.

Payloads equal byte for byte share one ``response``, that of the smallest page id; the others are ``revisit`` records that
refer to it. Rows that repeat a page id and its payload are all responses if theirs is the smallest id. A null html is an
empty payload; a null id or url leaves its header out; with only null ids in a group all are responses. An empty table
writes no archive and reads back no record.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchfloor.llm.common import checkpointed, map_batches, new_folder

CHUNK = 1 << 16
ARCHIVE_BYTES = 256 << 20  # inflated bytes after which a task begins another archive
RANGE_BYTES = 8 << 20  # compressed bytes of neighbouring members read by one task
RECORD_ID = "<urn:page:{}>"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "path string, records long"
NORMALISED = "path string, index string, records long"


def file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {RECORD_ID.format('' if page_id is None else page_id)}",
        *([] if url is None else [f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~-._')}"]),
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        *([] if refers_to is None else [f"WARC-Refers-To: {RECORD_ID.format(refers_to)}", f"WARC-Profile: {PROFILE}"]),
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(head: bytes) -> dict[str, str]:
    """Header lines by lower-case name; the first line stays out."""
    lines = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    return {name.strip().lower(): value.strip() for name, _, value in lines}


def with_first(pages: DataFrame, id_col: str, url_col: str, html_col: str, least: int) -> DataFrame:
    """page_id, url, html, refers_to. Only digests that repeat are joined."""
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.coalesce(F.col(f"`{html_col}`"), F.lit("")).alias("html"))
    rows = rows.withColumn("sum", F.sha1(F.col("html").cast("binary")))
    groups = rows.filter(F.octet_length("html") >= least).groupBy("sum").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    first = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    joined = rows.join(groups.filter("n > 1").drop("n"), "sum", "left")
    return joined.select("page_id", "url", "html", first.alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0) -> DataFrame:
    """Monolithic archives of all pages below ``folder``: a manifest of (path, records). ``least``: smaller payloads never
    become revisits."""

    def run(batches):
        fs, base = file_system(folder)
        fs.create_dir(base, recursive=True)
        done, out, squeeze, path, size, n = [], None, None, "", 0, 0

        def close():
            out.write(squeeze.flush())
            out.close()
            done.append((path, n))

        for batch in batches:
            for page_id, url, html, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True):
                if out is None:
                    path = f"{base.rstrip('/')}/{uuid.uuid4().hex}.warc.gz"
                    out, squeeze, size, n = fs.open_output_stream(path, compression=None), zlib.compressobj(6, zlib.DEFLATED, 31), 0, 0
                data = record(page_id, url, html.encode("utf-8", "replace"), refers_to)
                out.write(squeeze.compress(data))
                size, n = size + len(data), n + 1
                if size >= ARCHIVE_BYTES:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([k for _, k in done], pa.int64())], ["path", "records"])

    return checkpointed(map_batches(with_first(pages, id_col, url_col, html_col, least), run, MANIFEST))


def inflated(file) -> Iterator[bytes]:
    """The content of a gzip file of one or many members, in chunks."""
    open_ = None
    while data := file.read(CHUNK):
        while data:
            open_ = open_ or zlib.decompressobj(31)
            if out := open_.decompress(data, CHUNK):
                yield out
            if open_.eof:
                data, open_ = open_.unused_data, None
            else:
                data = open_.unconsumed_tail
    if open_ is not None:
        raise ValueError("the archive ends inside a gzip member")


def split_records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], Iterator[bytes]]]:
    """(headers, pieces of the whole record) one after the other; the pieces must be used up before the next record."""
    held = b""
    for chunk in chunks:
        held += chunk
        while (end := held.find(b"\r\n\r\n")) >= 0:
            head = headers(held[:end])
            left = end + 4 + int(head["content-length"]) + 4

            def pieces():
                nonlocal held, left
                while left:
                    part, held = held[:left], held[left:]
                    left -= len(part)
                    if part:
                        yield part
                    if left:
                        held = next(chunks, b"")
                        if not held:
                            raise ValueError("the archive ends inside a record")

            yield head, pieces()
            for _ in pieces():
                pass
    if held:
        raise ValueError("the archive ends inside a record's headers")


def normalise(manifest: DataFrame, folder: str) -> DataFrame:
    """Each archive of ``manifest`` (column path) rewritten below ``folder`` in one member per record, with its index."""

    def run(batches):
        fs, base = file_system(folder)
        fs.create_dir(base, recursive=True)
        for batch in batches:
            rows = []
            for path in batch.column("path").to_pylist():
                stem = f"{base.rstrip('/')}/{uuid.uuid4().hex}"
                offset, n = 0, 0
                with fs.open_input_stream(path, compression=None) as file, fs.open_output_stream(f"{stem}.warc.gz", compression=None) as out, fs.open_output_stream(f"{stem}.idx") as index:
                    for head, pieces in split_records(inflated(file)):
                        squeeze, length = zlib.compressobj(6, zlib.DEFLATED, 31), 0
                        for piece in pieces:
                            data = squeeze.compress(piece)
                            out.write(data)
                            length += len(data)
                        data = squeeze.flush()
                        out.write(data)
                        length += len(data)
                        index.write(f"{offset}\t{length}\t{head.get('warc-type', '')}\t{head.get('warc-record-id', '')}\n".encode())
                        offset, n = offset + length, n + 1
                rows.append((f"{stem}.warc.gz", f"{stem}.idx", n))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], ["path", "index", "records"])

    paths = manifest.select("path").repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return checkpointed(map_batches(paths, run, NORMALISED))


def ranges(manifest: DataFrame, folder: str) -> DataFrame:
    """(path, start, length): neighbouring members that one task reads, from the sidecar indexes."""

    def run(batches):
        fs, _ = file_system(folder)
        for batch in batches:
            rows = []
            for path, index in zip(batch.column("path").to_pylist(), batch.column("index").to_pylist(), strict=True):
                start = end = 0
                with fs.open_input_stream(index) as file:
                    rest = b""
                    while data := file.read(CHUNK):
                        *lines, rest = (rest + data).split(b"\n")
                        for line in lines:
                            offset, length = map(int, line.split(b"\t", 2)[:2])
                            end = offset + length
                            if end - start >= RANGE_BYTES:
                                rows.append((path, start, end - start))
                                start = end
                if end > start:
                    rows.append((path, start, end - start))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], ["path", "start", "length"])

    return map_batches(manifest, run, "path string, start long, length long")


def read_records(manifest: DataFrame, folder: str) -> DataFrame:
    """Every record of normalised archives: record_id, record_type, refers_to, target_uri, payload_digest, http_bytes and
    payload (null for revisits). A response whose payload does not fit its digest is an error."""

    schema = pa.schema(
        [("record_id", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("target_uri", pa.string()), ("payload_digest", pa.string()), ("http_bytes", pa.int64()), ("payload", pa.binary())]
    )

    def parsed(data: bytes):
        head, _, rest = data.partition(b"\r\n\r\n")
        fields = headers(head)
        http, _, payload = rest[: int(fields["content-length"])].partition(b"\r\n\r\n")
        full, stated = fields["warc-type"] == "response", fields["warc-payload-digest"].removeprefix("sha1:")
        if full and digest(payload) != stated:
            raise ValueError(f"payload of {fields['warc-record-id']} does not fit its digest")
        return (
            fields["warc-record-id"], fields["warc-type"], fields.get("warc-refers-to"), fields.get("warc-target-uri"),
            stated, int(headers(http)["content-length"]), payload if full else None,
        )

    def run(batches):
        fs, _ = file_system(folder)
        for batch in batches:
            for path, start, length in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "length")), strict=True):
                with fs.open_input_file(path) as file:
                    file.seek(start)
                    data, at, rows, size = memoryview(file.read(length)), 0, [], 0
                while at < length:
                    member, out = zlib.decompressobj(31), []
                    while not member.eof:
                        part = data[at : at + CHUNK]
                        out.append(member.decompress(part))
                        at += len(part)
                    at -= len(member.unused_data)
                    rows.append(parsed(b"".join(out)))
                    size += len(rows[-1][-1] or b"")
                    if size >= RANGE_BYTES or at == length:
                        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)
                        rows, size = [], 0

    members = ranges(manifest, folder).repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return map_batches(members, run, "record_id string, record_type string, refers_to string, target_uri string, payload_digest string, http_bytes long, payload binary")


def archived(spark: SparkSession, pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0) -> DataFrame:
    """Pages written, normalised and read back: page_id, payload_bytes, payload_digest, record_type, refers_to, payload."""
    folder = folder or new_folder(spark, "warc")
    written = write_archives(pages, f"{folder}/monolithic", id_col, url_col, html_col, least)
    records = read_records(normalise(written, f"{folder}/members"), folder)

    def number(column: str):
        return F.regexp_extract(column, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")

    return records.select(
        number("record_id").alias("page_id"),
        F.coalesce(F.octet_length("payload").cast("long"), F.col("http_bytes")).alias("payload_bytes"),
        "payload_digest",
        "record_type",
        number("refers_to").alias("refers_to"),
        "payload",
    )
