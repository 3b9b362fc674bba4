"""Vectors and term postings of the searchable chunks."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askloom.functions.ranking import asked_only
from askloom.functions.text import segment_terms

Embedder = Callable[[DataFrame, str], DataFrame]
"""Adds a ``vector`` column computed from the named text column."""

# ---- fixed values ----
EMBED_DIM = 512
NORM_FLOOR = 1e-12
# ---- end of fixed values ----

TERM_ROWS = 2048
"""Texts whose terms are numbered and counted at once."""


def _term_slots(terms: pa.Array, dim: int) -> np.ndarray:
    """Vector position of every term: the first 32 bits of its MD5, modulo the dimension. Each different term is hashed once."""
    coded = terms.dictionary_encode()
    slots = [int.from_bytes(hashlib.md5(t, usedforsecurity=False).digest()[:4], "big") % dim for t in coded.dictionary.cast(pa.binary()).to_pylist()]
    return np.array(slots, np.int64)[np.asarray(coded.indices)]


def hashed_embedder(dim: int = EMBED_DIM, element: str = "float") -> Embedder:
    """Default embedder for use without a model: term counts over ``dim`` hashed positions, unit length.

    Terms are found in the JVM; one Arrow pass turns the terms of ``TERM_ROWS`` texts into positions and these into vectors.
    """
    def add(df: DataFrame, text: str) -> DataFrame:
        found = df.withColumn("_terms", segment_terms(F.col(text)))
        schema = T.StructType([*df.schema.fields, T.StructField("vector", T.ArrayType(T.FloatType() if element == "float" else T.DoubleType()))])
        names = df.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, len(whole), TERM_ROWS):
                    batch = whole.slice(at, TERM_ROWS)
                    lists = batch.column(batch.schema.get_field_index("_terms"))
                    rows = np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths()))
                    cells = np.bincount(rows * dim + _term_slots(lists.flatten(), dim), minlength=len(lists) * dim)
                    vectors = _vector_lists(cells.reshape(-1, dim).astype(np.float64), element)
                    yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(n)) for n in names] + [vectors],
                                                     names=[*names, "vector"])
        return found.mapInArrow(run, schema)
    return add


def _vector_lists(m: np.ndarray, element: str) -> pa.Array:
    unit = m / np.sqrt(np.maximum((m * m).sum(axis=1, keepdims=True), NORM_FLOOR))
    flat = pa.array(unit.astype(np.float32 if element == "float" else np.float64).ravel())
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), flat)


def model_embedder(load: Callable[[], Callable[[list[str]], np.ndarray]], batch: int = 32) -> Embedder:
    """Hook for a real model: ``load`` runs once per task, its result maps a list of texts to vectors."""
    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            vectors = [np.asarray(model(texts.iloc[i:i + batch].tolist()), dtype=np.float64)
                       for i in range(0, len(texts), batch)]
            full = np.concatenate(vectors) if vectors else np.zeros((0, 1))
            norms = np.sqrt(np.maximum((full * full).sum(axis=1, keepdims=True), NORM_FLOOR))
            yield pd.Series(list((full / norms).astype(np.float32)))
    return lambda df, text: df.withColumn("vector", run(F.col(text)))


def embed(chunks: DataFrame, embedder: Embedder, text: str = "content") -> DataFrame:
    """Vectors of the searchable chunks; parents carry none."""
    return embedder(chunks.filter(F.col("kind") == "child"), text)


def l2_normalize(vector: Column) -> Column:
    norm = F.sqrt(F.greatest(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x), F.lit(NORM_FLOOR)))
    return F.transform(vector, lambda x: x.cast("double") / norm)


def mean_pool_normalize(hidden: DataFrame, key: str, vector: str = "hidden", mask: str = "mask") -> DataFrame:
    """Mean of the unmasked token vectors per key, scaled to unit length. Sums are partial per task, so a key
    with many token rows is added up before the shuffle."""
    cells = (hidden.filter(F.col(mask) == 1)
             .select(key, F.posexplode(vector).alias("dim", "x"))
             .groupBy(key, "dim").agg(F.avg(F.col("x").cast("double")).alias("x")))
    pooled = cells.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("dim", "x"))).alias("cells"))
    return pooled.select(key, l2_normalize(F.col("cells.x")).alias("vector"))


def _children(chunks: DataFrame) -> DataFrame:
    return chunks.filter(F.col("kind") == "child") if "kind" in chunks.columns else chunks


def _term_groups(chunks: DataFrame, keys: tuple[str, ...], text: str, positions: bool) -> DataFrame:
    """One row per different term of a chunk, grouped inside the chunk's batch: terms are numbered, sorted by chunk and number, and a group is a run of equal ones."""
    terms = _children(chunks).select(*keys, segment_terms(F.col(text)).alias("_terms"))
    fields = [*terms.schema.fields[:-1], T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())]
    if positions:
        fields.append(T.StructField("positions", T.ArrayType(T.IntegerType())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), TERM_ROWS):
                batch = whole.slice(at, TERM_ROWS)
                lists = batch.column(batch.num_columns - 1)
                sizes = np.asarray(lists.value_lengths())
                coded = lists.flatten().dictionary_encode()
                if not len(coded):
                    continue
                owner = np.repeat(np.arange(len(lists)), sizes)
                key = owner * len(coded.dictionary) + np.asarray(coded.indices)
                order = np.argsort(key, kind="stable")
                starts = np.flatnonzero(np.diff(key[order], prepend=-1))
                first = order[starts]
                columns = [batch.column(i).take(pa.array(owner[first])) for i in range(len(keys))]
                ends = np.append(starts, len(order))
                columns += [coded.dictionary.take(coded.indices.take(pa.array(first))), pa.array(np.diff(ends))]
                if positions:
                    place = np.arange(len(order)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1
                    columns.append(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(place[order].astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return terms.mapInArrow(run, T.StructType(fields))


def build_postings(chunks: DataFrame, *keys: str, text: str = "content") -> DataFrame:
    """(keys, term, tf, positions) of the searchable chunks, positions from 1. A chunk is one row, so nothing is shuffled."""
    return _term_groups(chunks, keys, text, True)


def term_counts(chunks: DataFrame, *keys: str, text: str = "content") -> DataFrame:
    """Postings without positions."""
    return _term_groups(chunks, keys, text, False)


def asked_term_counts(chunks: DataFrame, terms: DataFrame, *keys: str, text: str = "content") -> DataFrame:
    """Postings of the asked terms (kb_id, term) only, for a recall without a stored index: all other terms are
    dropped before anything is shuffled. ``keys`` must hold ``kb_id``."""
    return asked_only(term_counts(chunks, *keys, text=text), terms)


def attach_parent(chunks: DataFrame) -> DataFrame:
    """Children with their parent's content, joined on document, strategy and parent position."""
    parents = chunks.filter(F.col("kind") == "parent").select(
        "doc_id", "strategy", F.col("chunk_index").alias("parent_index"),
        F.col("content").alias("parent_content"), F.col("token_count").alias("parent_tokens"))
    children = chunks.filter(F.col("kind") == "child")
    return children.join(parents, ["doc_id", "strategy", "parent_index"], "left")
