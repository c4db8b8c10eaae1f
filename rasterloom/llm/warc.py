"""WARC archives with an index written first, then read back by coalesced byte ranges.

Each task writes one archive, a gzip member for each record, and an index row for each: file, offset, length, URL,
digest. Selected index rows are sorted by place; neighbouring ranges are read at once, and each record is checked against
its digest. Archives go to the shared folder; names are unique for each attempt, and only the index says which count.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lookup, make_folder, new_folder, stored

INDEX = "file string, offset long, length long, page_id long, url string, payload_digest string, record_type string"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
CRLF = b"\r\n"
#: The space of the records' names.
NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def _record_id(page_id: int | None, place: str) -> str:
    """A name by page and place, so that rows that repeat have their own."""
    return f"<urn:uuid:{uuid.uuid5(NAMES, f'{page_id} {place}')}>"


def _clean(value: str) -> bytes:
    """A header's value: percent-encoded line ends, so that a header stays one line."""
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A").encode("utf-8", "surrogatepass")


def _plain(value: bytes) -> str:
    return value.decode("utf-8", "surrogatepass").replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def encode_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, place: str = "") -> bytes:
    """One WARC/1.1 record. A revisit keeps the HTTP header of its response, with the payload's length, and no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    lines = [b"WARC/1.1", b"WARC-Type: " + (b"revisit" if revisit else b"response"), b"WARC-Record-ID: " + _record_id(page_id, place).encode(), b"WARC-Date: 2020-01-01T00:00:00Z"]
    if url is not None:
        lines.append(b"WARC-Target-URI: " + _clean(url))
    lines.append(b"WARC-Payload-Digest: sha256:" + digest.encode())
    if page_id is not None:
        lines.append(b"X-Page-ID: %d" % page_id)
    if revisit:
        lines += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", b"X-Refers-To-Page-ID: %d" % refers_to]
    lines += [b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block)]
    return CRLF.join(lines) + CRLF * 2 + block + CRLF * 2


def decode_record(raw: bytes) -> dict:
    """The fields of a record, checked against its digest."""
    head, _, rest = raw.partition(CRLF * 2)
    fields = dict(line.split(b": ", 1) for line in head.split(CRLF)[1:])
    block = rest[: int(fields[b"Content-Length"])]
    http, _, payload = block.partition(CRLF * 2)
    size = int(dict(line.split(b": ", 1) for line in http.split(CRLF)[1:])[b"Content-Length"])
    kind, digest = fields[b"WARC-Type"].decode(), fields[b"WARC-Payload-Digest"].decode().removeprefix("sha256:")
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("a record's payload doesn't match its digest")
    number = lambda k: int(fields[k]) if k in fields else None
    return {"page_id": number(b"X-Page-ID"), "url": _plain(fields[b"WARC-Target-URI"]) if b"WARC-Target-URI" in fields else None, "record_type": kind, "refers_to": number(b"X-Refers-To-Page-ID"), "payload_bytes": size, "payload_digest": digest, "payload": payload if kind == "response" else None}


#: Schemes that Spark and Arrow name differently.
SCHEMES = {"s3a": "s3", "s3n": "s3", "wasbs": "abfs"}
#: A read has at most so many tasks; with more bytes, each reads more blocks.
MOST_TASKS = 1 << 14


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path as Spark names it, and the path there."""
    scheme, mark, rest = uri.partition("://")
    uri = SCHEMES.get(scheme, scheme) + mark + rest
    return fs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri)


def _writer(folder: str, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, at, uri = None, 0, f"{folder}/{uuid.uuid4().hex}.warc.gz"
        try:
            for batch in batches:
                rows = []
                for page_id, url, html, refers_to in zip(*[batch.column(batch.schema.get_field_index(c)) for c in ("page_id", "url", "html", "refers_to")]):
                    page_id, url, refers_to, payload = page_id.as_py(), url.as_py(), refers_to.as_py(), html.as_buffer() if html.is_valid else b""
                    payload = bytes(payload)
                    revisit, digest = refers_to is not None, hashlib.sha256(payload).hexdigest()
                    gz = zlib.compressobj(level, zlib.DEFLATED, 31)
                    member = gz.compress(encode_record(page_id, url, payload, digest, refers_to, revisit, f"{uri} {at}")) + gz.flush()
                    if out is None:
                        system, path = _open(uri)
                        out = system.open_output_stream(path, compression=None)
                    out.write(member)
                    rows.append((uri, at, len(member), page_id, url, digest, "revisit" if revisit else "response"))
                    at += len(member)
                if rows:
                    cols = list(zip(*rows))
                    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["file", "offset", "length", "page_id", "url", "payload_digest", "record_type"])
        finally:
            if out is not None:
                out.close()

    return run


def first_pages(pages: DataFrame, least: int) -> DataFrame:
    """(payload_digest, refers_to): for payloads of at least ``least`` bytes that several rows have, the smallest page_id."""
    html = F.coalesce("html", F.lit(""))
    sized = pages.select("page_id", F.sha2(html.cast("binary"), 256).alias("payload_digest"), F.octet_length(html).alias("size")).where(F.col("size") >= least)
    return sized.groupBy("payload_digest").agg(F.min("page_id").alias("first_page"), F.count(F.lit(1)).alias("n")).where("n > 1 AND first_page IS NOT NULL").select("payload_digest", "first_page")


def write_archives(pages: DataFrame, folder: str | None = None, least: int = 100, level: int = 3) -> DataFrame:
    """Write a record for each row of ``pages`` (page_id, url, html); return the stored index.

    Of rows with equal payloads of at least ``least`` bytes, those with the smallest page_id are responses and the others
    revisit it; a null page_id is never the smallest. Rows that repeat the smallest page_id are responses as well. Null
    html is an empty payload, a null url has no target header. An empty table has an empty index and no archive.
    """
    spark = pages.sparkSession
    folder = folder or new_folder(spark, "warc")
    rows = pages.select(F.col("page_id").cast("long"), "url", "html")
    firsts = stored(first_pages(rows, least), "first-pages")
    html = F.coalesce("html", F.lit(""))
    rows = lookup(rows.withColumn("payload_digest", F.when(F.octet_length(html) >= least, F.sha2(html.cast("binary"), 256))), firsts, ["payload_digest"], "left", 160)
    refers = F.when(F.col("first_page").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_page")), F.col("first_page"))
    sent = rows.select("page_id", "url", F.col("html").cast("binary").alias("html"), refers.alias("refers_to"))
    folder = make_folder(spark, folder)  # pyarrow makes none, and a file system needs it
    return stored(sent.mapInArrow(_writer(folder, level), INDEX), "warc-index")


def _reader(gap: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        handle, opened = None, None

        def fetch(ranges: list) -> pa.RecordBatch:
            start, end = ranges[0][1], ranges[-1][1] + ranges[-1][2]
            handle.seek(start)
            data = handle.read(end - start)
            found = [decode_record(zlib.decompress(data[o - start : o - start + n], 31)) for _, o, n in ranges]
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
            return pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], t) for c, t in zip(names, kinds)], names=names)

        run_of: list = []
        for batch in batches:
            for file, offset, length in zip(*[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("file", "offset", "length")]):
                if run_of and (file != opened or offset > run_of[-1][1] + run_of[-1][2] + gap or offset + length - run_of[0][1] > most):
                    yield fetch(run_of)
                    run_of = []
                if file != opened:
                    if handle is not None:
                        handle.close()
                    system, path = _open(file)
                    handle, opened = system.open_input_file(path), file
                run_of.append((file, offset, length))
        if run_of:
            yield fetch(run_of)
        if handle is not None:
            handle.close()

    return run


def read_records(index: DataFrame, gap: int = 64 << 10, most: int = 8 << 20, block: int = 8 << 20) -> DataFrame:
    """The records that the rows of ``index`` (file, offset, length) select, with payloads.

    Rows are dealt by file and block of ``block`` bytes and sorted by offset; ranges at most ``gap`` bytes apart are read
    together, up to ``most`` bytes at once (a longer record by itself).
    """
    # the index is small and the archives aren't: adaptive execution would join its partitions into one task
    tasks = min(MOST_TASKS, 1 + int((index.agg(F.sum("length").alias("n")).first()["n"] or 0) // block))
    placed = index.select("file", "offset", "length").repartition(tasks, "file", F.expr(f"offset div {block}")).sortWithinPartitions("file", "offset")
    return placed.mapInArrow(_reader(gap, most), RECORDS)
