"""N-gram Jaccard self-join of whole texts by set-relation skipping.

A document's set are its distinct shingles of five words in the order of their hashes. The order is cut into as many
blocks of positions as two linked sets can differ in elements, and some more; an index list holds the sets whose block has
the same content. Two sets within the threshold agree in at least one block, so every other block, and with it every list, is skipped as
a whole: sets that only share a passage or frequent words hardly ever fill a block with nothing else.

Sizes fall into classes of ratio 1.25, the largest ratio of two linked sets. A set posts its blocks for its own class and for every
class that a larger partner can be in, each cut as finely as the largest possible difference asks for.

Answers are derived from those of similar sets: equal sets are one set, a set's answers are those of the component of the leader it is
linked with, and only what these leave open is compared (see :func:`askloom.llm.setindex.resolve`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askloom.llm import setindex
from askloom.llm.common import drop, jaccard_counts, lean, mix, set_ids, shingle_sets, slices, store

PERCENT = 80
RATIO = 1.25
SPARE = 0.25
"""Share of blocks beyond the largest difference, so that blocks without elements leave enough others."""


def class_starts(largest: int) -> np.ndarray:
    """Smallest set size of each class, up to one beyond ``largest``."""
    starts = [1]
    while starts[-1] <= largest * RATIO + 1:
        starts.append(max(starts[-1] + 1, int(starts[-1] * RATIO)))
    return np.array(starts, np.int64)


def largest_difference(size: np.ndarray) -> np.ndarray:
    """Most elements in which a set of at most ``size`` elements and a linked one that is no larger can differ."""
    return 2 * size * (100 - PERCENT) // (100 + PERCENT)


def block_numbers(cls: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(blocks, largest difference) of the classes ``cls``."""
    differ = largest_difference(starts[np.minimum(cls + 1, len(starts) - 1)] - 1)
    return differ + 1 + np.ceil(SPARE * (differ + 1)).astype(np.int64), differ


def cut_blocks(tokens: np.ndarray, offsets: np.ndarray) -> Iterator[tuple]:
    """For each class that sets post in, beginning with their own: (class, blocks, largest difference, which sets post, number of the set
    and position of every block with elements, its lane)."""
    sizes = np.diff(offsets)
    if not len(tokens):
        return
    starts = class_starts(int(sizes.max()))
    own = np.maximum(np.searchsorted(starts, sizes, "right") - 1, 0)
    highest = np.searchsorted(starts, np.floor(sizes * RATIO).astype(np.int64), "right") - 1
    content = mix(tokens)
    for step in range(int((highest - own)[sizes > 0].max()) + 1):
        cls = own + step
        blocks, differ = block_numbers(cls, starts)
        # sets that differ in nothing are equal and need no list
        use = (sizes > 0) & (cls <= highest) & (differ > 0)
        if not use.any():
            continue
        pick = np.repeat(use, sizes)
        owner = np.repeat(np.arange(len(sizes)), sizes)[pick]
        place = (tokens[pick] >> np.uint64(32)) * blocks[owner].astype(np.uint64) >> np.uint64(32)
        cut = np.ones(len(owner), bool)
        cut[1:] = (owner[1:] != owner[:-1]) | (place[1:] != place[:-1])
        begin = np.flatnonzero(cut)
        lane = (mix(np.add.reduceat(content[pick], begin)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        yield cls, blocks, differ, use, owner[begin], place[begin].astype(np.int64), lane


def block_postings(tokens: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, number of the set) for the blocks of all sets."""
    keys, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for cls, blocks, differ, use, who, where, lane in cut_blocks(tokens, offsets):
        keys.append(setindex.list_keys(cls[who], where, lane))
        owners.append(who)
        empty = blocks - np.bincount(who, minlength=len(use))
        # sets that may have nothing but empty blocks in common
        for i in np.flatnonzero(use & (empty >= blocks - differ)).tolist():
            none = np.setdiff1d(np.arange(blocks[i]), where[who == i])
            keys.append(setindex.list_keys(np.full(len(none), cls[i]), none, np.zeros(len(none), np.uint32)))
            owners.append(np.full(len(none), i))
    return np.concatenate(keys), np.concatenate(owners)


def _lanes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, texts in slices(batch.column(1)):
            tokens, offsets = shingle_sets(texts)
            parity = pa.array(setindex.parity_bitmaps(tokens, offsets), pa.binary())
            for step, (cls, _, _, use, who, where, lane) in enumerate(cut_blocks(tokens, offsets)):
                table = np.zeros((len(use), setindex.WIDE), np.uint32)
                near = where < setindex.WIDE
                table[who[near], where[near]] = lane[near]
                rows = np.flatnonzero(use)
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, len(texts)).take(at), pa.array(cls[rows], pa.int32()), pa.array(np.full(len(rows), step == 0)),
                     pa.array(np.diff(offsets)[rows]), pa.array(setindex.wide_lanes(table[rows]), pa.binary()), parity.take(at)],
                    ["set_id", "cls", "own", "size", "wide", "parity"])


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, texts in slices(batch.column(1)):
            tokens, offsets = shingle_sets(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), pa.array(np.diff(offsets)), pa.array(set_ids(tokens, offsets))],
                                             ["doc_id", "n_shingles", "set_id"])


def _posting_task(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in slices(batch.column(0)):
                tokens, offsets = shingle_sets(texts)
                ids = set_ids(tokens, offsets)
                _, first = np.unique(ids, return_index=True)
                fresh = np.zeros(len(ids), bool)
                fresh[first] = True
                tokens, offsets, ids = tokens[np.repeat(fresh, np.diff(offsets))], np.concatenate(
                    ([0], np.cumsum(np.diff(offsets)[fresh]))), ids[fresh]
                keys, owners = block_postings(tokens, offsets)
                rows = list(setindex.pack(keys, ids[owners], buckets))
                if rows:
                    yield setindex.posting_batch(rows)
    return run


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, a in slices(batch.column(2), 1 << 20):
            b = [t or b"" for t in batch.column(3).slice(start, len(a)).cast(pa.binary()).to_pylist()]
            common, union = jaccard_counts(a, b)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(a)), batch.column(1).slice(start, len(a)),
                                              pa.array(common / np.maximum(union, 1)), pa.array((100 * common >= PERCENT * union) & (union > 0))],
                                             ["a", "b", "similarity", "linked"])


def _of_the_set(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, set_id) in order of the id, whose text has that very set, as :data:`setindex.ITEMS`. An id may occur with several texts and rows may repeat:
    of those that follow each other one is kept."""
    last = None
    for batch in batches:
        for start, texts in slices(batch.column(1)):
            tokens, offsets = shingle_sets(texts)
            own = set_ids(tokens, offsets)
            rows = batch.slice(start, len(texts))
            want = rows.column(2).to_numpy()
            at = np.flatnonzero(own == want)
            if len(at):
                fresh = np.concatenate(([want[at[0]] != last], want[at[1:]] != want[at[:-1]]))
                last = want[at[-1]]
                at = at[fresh]
                yield pa.RecordBatch.from_arrays([rows.column(c).take(pa.array(at)) for c in (2, 1)] + setindex.sketches(tokens, offsets, at),
                                                 ["set_id", "content", "size", "parity", "long"])


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, n_shingles, component_id) for every row of ``docs`` with an id.

    component_id is the smallest id reachable over links (shingle sets with Jaccard similarity of at least 0.8), the row's own
    included. A null or empty text, or one of white space, has an empty set and links with nothing, not even with another empty
    one. Rows that repeat an id are described each by their own text. Rows with a null id have no place in a component and give a null component_id. Other columns are ignored whatever their names. An
    empty table gives no rows.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    described = store(base.mapInArrow(lean(_describe), "doc_id long, n_shingles long, set_id long"), "ngram-described")
    filled = described.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    sets = filled.groupBy("set_id").agg(F.min("doc_id").alias("rep"))
    postings = base.filter("doc_id IS NOT NULL").select("text").mapInArrow(lean(_posting_task(setindex.bucket_count(base))), setindex.POSTINGS)
    lists = setindex.shared_lists(postings, "ngram")

    def contents(ids: DataFrame) -> DataFrame:
        wanted = store(sets.join(ids, "set_id").select(F.col("rep").alias("doc_id"), "set_id"), "ngram-wanted")
        # the merge join leaves rows of one id side by side
        return base.join(wanted.hint("merge"), "doc_id").select("doc_id", "text", "set_id").mapInArrow(lean(_of_the_set), setindex.ITEMS)

    linked = setindex.resolve(lists, contents, _lanes, _compare, PERCENT, "ngram")
    labelled = sets.join(linked, "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    least = labelled.groupBy("component").agg(F.min("rep").alias("component_id"))
    per_set = labelled.join(least, "component").select("set_id", "component_id")
    drop(lists)
    per_row = described.join(per_set, "set_id", "left").withColumn(
        "component_id", F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))))
    return per_row.select(F.col("doc_id").alias(id_col), "n_shingles", "component_id")

