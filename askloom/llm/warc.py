"""WARC archives: written as one whole-file gzip stream each, normalised to a member per record with a sidecar index, read back.

The normaliser inflates a monolithic stream once, finds the records by their headers, writes each as a gzip member of its own, and notes its
offset and length. Archives are rows (archive, data) of a Parquet table in the shared folder, one archive of bounded size per row, so any
storage that Spark writes holds them; :func:`read_archive_files` takes the same rows from ``.warc.gz`` files.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askloom.llm.common import store

ARCHIVE_BYTES = 16 << 20
"""An archive is closed when its records reach this size; one record may be longer and is then an archive of its own."""
LEVEL = 1
ARCHIVES = "archive string, data binary"
DATE = "2024-01-01T00:00:00Z"
_END = b"\r\n\r\n"
_PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, page_id: int, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record; a revisit has the response's HTTP header, which names the payload's length, but no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if kind == "revisit" else http + payload
    head = [b"WARC/1.1", b"WARC-Type: " + kind.encode(), b"WARC-Record-ID: <urn:page:%d>" % page_id,
            b"WARC-Target-URI: " + (url or "").encode().replace(b"\r", b"%0D").replace(b"\n", b"%0A"), b"WARC-Date: " + DATE.encode(),
            b"WARC-Payload-Digest: sha1:" + digest.encode(), b"Content-Type: application/http; msgtype=response"]
    if refers_to is not None:
        head += [b"WARC-Refers-To: <urn:page:%d>" % refers_to, b"WARC-Profile: " + _PROFILE]
    head.append(b"Content-Length: %d" % len(block))
    return b"\r\n".join(head) + _END + block + _END


def headers(block: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in block.decode("utf-8", "replace").split("\r\n")[1:])}


def inflate(data: bytes) -> Iterator[bytes]:
    """The plain bytes of a gzip file piece by piece, whether it is one stream or many members."""
    while data:
        stream = zlib.decompressobj(31)
        while data and not stream.eof:
            piece = stream.decompress(data, 1 << 20)
            data = stream.unconsumed_tail
            if piece:
                yield piece
            elif not data and not stream.eof:
                raise ValueError("the gzip stream ends early")
        data = stream.unused_data


def records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, whole record) of every record of a plain WARC stream; holds one record at a time."""
    held = bytearray()

    def fill(enough) -> bool:
        while not enough():
            piece = next(pieces, None)
            if piece is None:
                return False
            held.extend(piece)
        return True

    while True:
        if not fill(lambda: held.find(_END) >= 0):
            if held.strip():
                raise ValueError("the archive ends within a record")
            return
        head = held.find(_END)
        fields = headers(bytes(held[:head]))
        size = head + len(_END) + int(fields["content-length"]) + len(_END)
        if not fill(lambda: len(held) >= size):
            raise ValueError("the archive ends within a record")
        yield fields, bytes(held[:size])
        del held[:size]


def _gzip(data: bytes) -> bytes:
    c = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def normalise(data: bytes) -> tuple[bytes, list[tuple[str, str, int, int]]]:
    """A gzip file with one member per record and its index (record id, type, offset, length)."""
    out, index, at = [], [], 0
    for fields, whole in records(inflate(data)):
        member = _gzip(whole)
        index.append((fields["warc-record-id"], fields["warc-type"], at, len(member)))
        out.append(member)
        at += len(member)
    return b"".join(out), index


def with_record_types(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0) -> DataFrame:
    """(page_id, url, payload, record_type, refers_to): of equal payloads of at least ``least`` bytes the smallest id is the response.

    A null page is an empty payload. Rows that repeat the smallest id of their payload are responses too; rows with a null id are responses
    without counterpart.
    """
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8").alias("payload"))
    keyed = base.withColumn("key", F.sha1("payload"))
    first = keyed.groupBy("key").agg(F.min("page_id").alias("first"))
    other = F.col("page_id").isNotNull() & (F.col("page_id") != F.col("first")) & (F.length("payload") >= least)
    return keyed.join(first, "key").select(
        "page_id", "url", "payload", F.when(other, "revisit").otherwise("response").alias("record_type"),
        F.when(other, F.col("first")).alias("refers_to"))


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    stream, parts, size, name = None, [], 0, None

    def close() -> pa.RecordBatch:
        parts.append(stream.flush())
        return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([b"".join(parts)], pa.binary())], ["archive", "data"])

    for batch in batches:
        for page_id, url, payload, kind, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            number = -1 if page_id is None else page_id
            digest = payload_digest(payload)
            whole = record(kind, number, url, payload, digest, refers_to)
            if stream is None:
                stream, parts, size = zlib.compressobj(LEVEL, zlib.DEFLATED, 31), [], 0
                name = f"pages-{hashlib.sha1(f'{number} {digest} {url}'.encode()).hexdigest()[:16]}.warc.gz"
            parts.append(stream.compress(whole))
            size += len(whole)
            if size >= ARCHIVE_BYTES:
                yield close()
                stream = None
    if stream is not None:
        yield close()


def write_archives(typed: DataFrame) -> DataFrame:
    """Monolithic archives (archive, data) of the rows of :func:`with_record_types`, stored. No rows, no archives."""
    return store(typed.select("page_id", "url", "payload", "record_type", "refers_to").mapInArrow(_write, ARCHIVES), "warc")


def read_archive_files(spark: SparkSession, path: str) -> DataFrame:
    """(archive, data) of ``.warc.gz`` files of up to 2 GB each."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("archive"), F.col("content").alias("data"))


def normalise_archives(archives: DataFrame) -> DataFrame:
    """(archive, data, entries) with one member per record; entries is the sidecar index (record_id, record_type, offset, length). Stored."""
    entry = pa.struct([("record_id", pa.string()), ("record_type", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out, index = normalise(data)
                rows = [dict(zip(("record_id", "record_type", "offset", "length"), e, strict=True)) for e in index]
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([out], pa.binary()), pa.array([rows], pa.list_(entry))],
                                                 ["archive", "data", "entries"])

    return store(archives.select("archive", "data").mapInArrow(
        run, ARCHIVES + ", entries array<struct<record_id:string,record_type:string,offset:long,length:long>>"), "warc-members")


def read_records(normalised: DataFrame) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to), each record inflated on its own at its indexed place.

    A response's length and digest are taken from the payload read and must agree with its header; a revisit's are what its header says.
    """
    def number(urn: str | None) -> int | None:
        found = None if urn is None else int(urn.strip("<>").rpartition(":")[2])
        return None if found == -1 else found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, entries in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = []
                for e in entries:
                    whole = zlib.decompress(data[e["offset"]:e["offset"] + e["length"]], 31)
                    head, _, block = whole.partition(_END)
                    fields = headers(head)
                    block = block[:int(fields["content-length"])]
                    http, _, payload = block.partition(_END)
                    size, digest = int(headers(http)["content-length"]), fields["warc-payload-digest"].removeprefix("sha1:")
                    if fields["warc-type"] == "response" and (len(payload), payload_digest(payload)) != (size, digest):
                        raise ValueError(f"record {e['record_id']} does not hold its payload")
                    rows.append((number(fields["warc-record-id"]), fields["warc-target-uri"], size, digest, fields["warc-type"],
                                 number(fields.get("warc-refers-to"))))
                if rows:
                    c = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c[0], pa.int64()), pa.array(c[1], pa.string()), pa.array(c[2], pa.int64()), pa.array(c[3], pa.string()),
                         pa.array(c[4], pa.string()), pa.array(c[5], pa.int64())],
                        ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return normalised.select("data", "entries").mapInArrow(
        run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")
