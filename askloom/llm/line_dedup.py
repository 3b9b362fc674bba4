"""Line dedup: lines that several documents hold stay in the first of them only.

Hashed line keys are range-partitioned by (key, document, position) and sorted; a stream over each partition sees a key's first document first. A key may run over
several partitions: each partition also says which document it met first for its first and its last key, at most two rows a partition, and the few lines of its first run that these
can still overrule wait for them. The result is a bitmap of kept lines per document, compressed; texts meet it only where they are wanted.

Rows. A null or empty text is one empty line. Rows with one id are one document; null ids are one document too, after all others. Rows that repeat id and text share a
bitmap. Lines whose key is shorter than ``LEAST_POINTS`` code points always stay. An empty table gives none.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askloom.llm.common import SLICE_BYTES, partitions, store

# ---- fixed values ----
LEAST_POINTS = 10
WHITE = b" \t\n\x0b\f\r"
# ---- end of fixed values ----

LINES = "h1 bigint, h2 bigint, doc_id bigint, row binary, pos int, tie bigint"
FOUND = "kind tinyint, h1 bigint, h2 bigint, doc_id bigint, row binary, pos int"
DROPPED, WAITING, CLAIM = 0, 1, 2


def row_key(doc_id: str = "doc_id", text: str = "text"):
    """128 bits of a row's id and text (null text: empty)."""
    return F.substring(F.unhex(F.sha2(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("-")), F.lit(":"), F.coalesce(text, F.lit(""))), 256)), 1, 16)


def line_key(line: bytes) -> bytes | None:
    """A line without white space at its ends, A-Z in lower case; None if it is too short to count."""
    key = line.strip(WHITE).lower()
    if len(key) < LEAST_POINTS or (len(key) < 4 * LEAST_POINTS and len(key.decode()) < LEAST_POINTS):
        return None
    return key


def _hash_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per line that counts, in slices of bounded size."""
    def out(digests: bytearray, rows: list[int], places: list[int], batch: pa.RecordBatch) -> pa.RecordBatch:
        halves = np.frombuffer(bytes(digests), np.int64).reshape(-1, 2)
        taken = pa.array(rows, pa.int64())
        columns = [batch.column(c).take(taken) for c in ("doc_id", "row")]
        return pa.RecordBatch.from_arrays([pa.array(halves[:, 0]), pa.array(halves[:, 1]), *columns, pa.array(places, pa.int32()), batch.column("tie").take(taken)],
                                          names=["h1", "h2", "doc_id", "row", "pos", "tie"])

    for batch in batches:
        digests, rows, places = bytearray(), [], []
        texts = batch.column("text").cast(pa.binary())
        for i in range(len(texts)):
            for place, line in enumerate((texts[i].as_py() or b"").split(b"\n")):
                key = line_key(line)
                if key is None:
                    continue
                digests += hashlib.blake2b(key, digest_size=16).digest()
                rows.append(i)
                places.append(place)
                if len(digests) >= SLICE_BYTES:
                    yield out(digests, rows, places, batch)
                    digests, rows, places = bytearray(), [], []
        if rows:
            yield out(digests, rows, places, batch)


def _stream_firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one sorted partition: lines outside their key's first document here, lines of the first run that may yet be outside, claims of the first and the last run.

    Only the open run's key and first document are kept between batches.
    """
    run = first = None
    in_first_run = True
    for batch in batches:
        if not len(batch):
            continue
        h1, h2 = np.asarray(batch.column("h1")), np.asarray(batch.column("h2"))
        missing = np.asarray(batch.column("doc_id").is_null())
        docs = np.asarray(batch.column("doc_id").fill_null(0))
        begins = np.ones(len(h1), bool)
        begins[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        begins[0] = run != (h1[0], h2[0])
        number = np.cumsum(begins)
        starts = np.flatnonzero(begins)
        if first is None:
            first = (docs[0], missing[0])
        first_doc = np.concatenate(([first[0]], docs[starts]))[number]
        first_missing = np.concatenate(([first[1]], missing[starts]))[number]
        outside = (docs != first_doc) | (missing != first_missing)
        if run is None:
            number -= 1
            yield _claims([(h1[0], h2[0], docs[0], missing[0])])
        waiting = ~outside & (number == 0) & in_first_run
        taken = np.flatnonzero(outside | waiting)
        if len(taken):
            part = batch.take(pa.array(taken))
            kind = pa.array(np.where(outside[taken], DROPPED, WAITING).astype(np.int8))
            yield pa.RecordBatch.from_arrays([kind, *[part.column(c) for c in ("h1", "h2", "doc_id", "row", "pos")]], names=["kind", "h1", "h2", "doc_id", "row", "pos"])
        in_first_run = in_first_run and not number[-1]
        run, first = (h1[-1], h2[-1]), (first_doc[-1], first_missing[-1])
    if run is not None:
        yield _claims([(*run, *first)])


def _claims(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([CLAIM] * len(rows), pa.int8()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
         pa.array([None if r[3] else int(r[2]) for r in rows], pa.int64()), pa.array([None] * len(rows), pa.binary()), pa.array([None] * len(rows), pa.int32())],
        names=["kind", "h1", "h2", "doc_id", "row", "pos"])


def dropped_lines(documents: DataFrame) -> DataFrame:
    """(row, pos) of the lines to drop; rows that repeat id and text may give a line more than once.

    ``tie`` parts repeated rows in the range sort. The claims that are broadcast are two rows a partition at most.
    """
    spark = documents.sparkSession
    slim = documents.select("doc_id", row_key().alias("row"), "text", F.monotonically_increasing_id().alias("tie"))
    lines = store(slim.mapInArrow(_hash_lines, LINES), "line-keys")
    order = [F.col("h1"), F.col("h2"), F.asc_nulls_last("doc_id"), F.col("pos"), F.col("tie")]
    found = store(lines.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).mapInArrow(_stream_firsts, FOUND), "line-firsts")
    claims = found.filter(F.col("kind") == CLAIM).groupBy("h1", "h2").agg(F.min("doc_id").alias("first_doc"))
    overruled = found.filter(F.col("kind") == WAITING).join(F.broadcast(claims), ["h1", "h2"]).filter(~F.col("doc_id").eqNullSafe(F.col("first_doc")))
    return found.filter(F.col("kind") == DROPPED).select("row", "pos").unionByName(overruled.select("row", "pos"))


def pack(count: int, dropped: np.ndarray) -> bytes:
    keep = np.ones(count, bool)
    keep[dropped] = False
    return zlib.compress(np.packbits(keep).tobytes())


def unpack(bitmap: bytes, count: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=count).astype(bool)


def _pack_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("dropped")
        maps = [pack(n, np.asarray(lists[i].values if lists[i].is_valid else pa.array([], pa.int32())))
                for i, n in enumerate(batch.column("n_lines").to_pylist())]
        counts = lists.value_lengths().fill_null(0).cast(pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), batch.column("n_lines"), counts, pa.array(maps, pa.binary())],
                                         names=["row", "doc_id", "n_lines", "n_dropped", "keep"])


def keep_bitmaps(documents: DataFrame) -> DataFrame:
    """(row, doc_id, n_lines, n_dropped, keep) per different (doc_id, text): ``keep`` is the compressed bitmap of the lines that stay.

    The positions of one row's dropped lines are bounded by its text.
    """
    text = F.coalesce("text", F.lit(""))
    lines = (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")
    rows = documents.select(row_key().alias("row"), "doc_id", lines.alias("n_lines")).distinct()
    dropped = dropped_lines(documents).groupBy("row").agg(F.collect_set("pos").alias("dropped"))
    return rows.join(dropped, "row", "left").select("row", "doc_id", "n_lines", "dropped").mapInArrow(
        _pack_batches, "row binary, doc_id bigint, n_lines bigint, n_dropped bigint, keep binary")


def _cut_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, maps, counts = batch.column("text").cast(pa.binary()), batch.column("keep"), batch.column("n_lines").to_pylist()
        dropped = batch.column("n_dropped").to_pylist()
        kept = []
        for i, n in enumerate(counts):
            text = texts[i].as_py() or b""
            if dropped[i]:
                text = b"\n".join([line for line, stay in zip(text.split(b"\n"), unpack(maps[i].as_py(), n).tolist(), strict=True) if stay])
            kept.append(text)
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "n_lines", "n_dropped")], pa.array(kept, pa.binary()).cast(pa.string())],
                                         names=["doc_id", "n_lines", "n_dropped", "kept"])


def apply_bitmaps(documents: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept) of every row of ``documents``: its text with only the lines that its bitmap keeps."""
    rows = documents.select(row_key().alias("row"), "doc_id", "text").join(bitmaps.select("row", "n_lines", "n_dropped", "keep"), "row")
    return rows.select("doc_id", "text", "n_lines", "n_dropped", "keep").mapInArrow(_cut_batches, "doc_id bigint, n_lines bigint, n_dropped bigint, kept string")
