"""Helpers shared by the operators: tables, stored intermediates, bounded slices of Arrow batches, word shingles."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askloom import session

SHINGLE_WORDS = 5
SLICE_BYTES = 2 << 20
"""Bytes of text worked on at once in a task; one text may be longer and is then a slice of its own."""

_MIX1, _MIX2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x100000001B3)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that later jobs neither recompute nor lose it."""
    return session.materialize(df, f"llm-{name}")


def drop(*tables: DataFrame) -> None:
    """Delete tables of :func:`store` whose last reader is stored itself."""
    for table in tables:
        session.discard(table)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive texts of an Arrow string column as bytes (null: empty), at most ``limit`` bytes or one text at a time."""
    start, size, held = 0, 0, []
    for i, text in enumerate(column.cast(pa.binary()).to_pylist()):
        text = text or b""
        if held and size + len(text) > limit:
            yield start, held
            start, size, held = i, 0, []
        held.append(text)
        size += len(text)
    if held:
        yield start, held


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: nearby inputs become unrelated outputs."""
    with np.errstate(over="ignore"):
        x = x + _STEP
        x = (x ^ (x >> np.uint64(30))) * _MIX1
        x = (x ^ (x >> np.uint64(27))) * _MIX2
        return x ^ (x >> np.uint64(31))


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` as a task that gives the memory it has freed back at its end: Python workers live on and serve the tasks of later stages."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release_memory()
    return task


def release_memory() -> None:
    """Return freed memory to the system, as far as the allocators can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def is_white(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of ``texts`` (A-Z lower-cased, parted by ASCII white space) and the first word's number per text."""
    joined = np.frombuffer(b"\n".join([t.lower() for t in texts]) + b"\n", np.uint8)
    ends_of = np.cumsum([len(t) + 1 for t in texts])
    white = is_white(joined)
    before = np.concatenate(([True], white[:-1]))
    starts = np.flatnonzero(before & ~white)
    first = np.concatenate(([0], np.searchsorted(starts, ends_of)))
    if not len(starts):
        return np.zeros(0, np.uint64), first
    inside = np.flatnonzero(~white)
    lengths = np.flatnonzero(~before & white) - starts
    begin = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    place = np.arange(len(inside)) - np.repeat(begin, lengths)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(int(lengths.max()), _BASE, np.uint64))
        sums = np.add.reduceat((joined[inside].astype(np.uint64) + np.uint64(1)) * powers[place], begin)
        return mix(sums + lengths.astype(np.uint64) * _STEP), first


def shingle_hashes(words: np.ndarray, at: np.ndarray, width: np.ndarray, size: int = SHINGLE_WORDS) -> np.ndarray:
    """Hash of the ``width`` (at most ``size``) words from each of the places ``at``."""
    padded = np.concatenate((words, np.zeros(size, np.uint64)))
    with np.errstate(over="ignore"):
        total = width.astype(np.uint64) * _STEP
        for j in range(size):
            total = total * _BASE + np.where(width > j, padded[at + j], np.uint64(0))
    return mix(total)


def shingle_sets(texts: list[bytes], size: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed shingles of each text, ascending per text, and their offsets.

    A text of fewer than ``size`` words has its whole sequence as one shingle, a text without words none.
    """
    words, first = word_hashes(texts)
    counts = np.diff(first)
    number = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    offsets = np.concatenate(([0], np.cumsum(number)))
    at = np.arange(offsets[-1]) + np.repeat(first[:-1] - offsets[:-1], number)
    tokens = shingle_hashes(words, at, np.repeat(np.minimum(counts, size), number), size)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        tokens[a:b].sort()
    keep = np.ones(len(tokens), bool)
    keep[1:] = tokens[1:] != tokens[:-1]
    keep[offsets[:-1][number > 0]] = True
    kept = np.concatenate(([0], np.cumsum(keep)))
    return tokens[keep], kept[offsets]


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum (modulo 2^64) per segment; 0 for an empty one."""
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)))
        return sums[offsets[1:]] - sums[offsets[:-1]]


def set_ids(tokens: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint per set; equal sets have equal ones."""
    with np.errstate(over="ignore"):
        return mix(segment_sums(mix(tokens ^ _MIX1), offsets) + np.diff(offsets).astype(np.uint64) * _MIX2).view(np.int64)


def jaccard_counts(a: list[bytes], b: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the intersection and the union of the shingle sets of paired texts."""
    # a text of several pairs is cut to shingles once
    number: dict[bytes, int] = {}
    left, right = (np.array([number.setdefault(t, len(number)) for t in texts], np.int64) for texts in (a, b))
    tokens, offsets = shingle_sets(list(number))
    parts = np.split(tokens, offsets[1:-1])
    common = np.array([np.intersect1d(parts[i], parts[j], assume_unique=True).size for i, j in zip(left.tolist(), right.tolist(), strict=True)], np.int64)
    sizes = np.diff(offsets)
    return common, sizes[left] + sizes[right] - common


def smallest(*columns: str) -> list:
    return [F.col(c).asc_nulls_first() for c in columns]
