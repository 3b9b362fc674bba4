"""Exact recalls for whole tables of questions: tiles of questions meet blocks of chunks of their knowledge base.

Both recalls have one path for any number of questions. Blocks are packed where the chunks lie; tiles of at most ``TILE_QUESTIONS`` questions join them by
knowledge base, broadcast if Catalyst's size estimate allows and else shuffled in shares. A task works on one (tile, block) at a time and remembers the best k of the questions it has
met in ``STATE_BYTES`` at most; what falls out of that memory is sent on, so memory does not grow with questions or chunks. Only the best k per question and task
become rows, and these are cut in two steps, so no question has one reducer for all tasks.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askloom.functions.ranking import TERM_GROWTH, asked_only, broadcast_limit, estimated_bytes, salted_join, top_n

RECALL_K = 50
COVER_WEIGHT = 0.1
SCORE_DIGITS = 6

TILE_QUESTIONS = 128
BLOCK_BYTES = 1 << 20
"""Bytes of vectors in a block; with a tile of 512 dimensions a pair is about 1.5 MB of input and 0.25 MB of scores."""
BLOCK_CHUNKS = 512
"""Chunks in a block of the term index."""
STATE_BYTES = 64 << 20
SHARES = 16
MANY_QUESTIONS = 1024
"""Questions in a tile of vectors that is shuffled."""
TILE_SHARES, BLOCK_SHARES = 16, 4

HITS = "q_id bigint, chunk_id bigint, score double"
_NONE = np.iinfo(np.int64).max


class Best:
    """Best ``k`` chunks of every question of the tiles met so far, ties by chunk id. Least recently used tiles leave when the memory is full."""

    def __init__(self, k: int, limit: int | None = None):
        self.k, self.limit, self.size = k, STATE_BYTES if limit is None else limit, 0
        self.held: OrderedDict[tuple, tuple[np.ndarray, np.ndarray, np.ndarray]] = OrderedDict()

    def state(self, key: tuple, q_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if key not in self.held:
            self.held[key] = (q_ids.copy(), np.full((len(q_ids), self.k), _NONE, np.int64), np.full((len(q_ids), self.k), -np.inf))
            self.size += 16 * len(q_ids) * self.k
        self.held.move_to_end(key)
        return self.held[key]

    def add(self, key: tuple, q_ids: np.ndarray, c_ids: np.ndarray, scores: np.ndarray, digits: int | None = None) -> None:
        """Take in the scores (questions by chunks) of one block; -inf is no hit. With ``digits`` they are rounded here, and only those that may count."""
        _, ids, held = self.state(key, q_ids)
        if np.isnan(scores).any():
            scores = np.where(np.isnan(scores), -np.inf, scores)
        least = held[:, -1:] if digits is None else held[:, -1:] - 10.0 ** -digits
        if len(c_ids) > self.k:
            # a row's k-th best of this block: what is under it can't count, and few are equal
            near = np.partition(scores, len(c_ids) - self.k, axis=1)[:, len(c_ids) - self.k, None] if (held[:, -1] == -np.inf).any() else -np.inf
            least = np.maximum(least, near if digits is None else near - 2 * 10.0 ** -digits)
        row, column = np.nonzero((scores >= least) & (scores > -np.inf))
        found = scores[row, column] if digits is None else np.round(scores[row, column], digits) + 0.0
        better = (found > held[row, -1]) | ((found == held[row, -1]) & (c_ids[column] < ids[row, -1]))
        row, column, found = row[better], column[better], found[better]
        if not len(row):
            return
        rows, place = np.unique(row, return_inverse=True)
        owner = np.concatenate((np.repeat(np.arange(len(rows)), self.k), place))
        all_scores, all_ids = np.concatenate((held[rows].ravel(), found)), np.concatenate((ids[rows].ravel(), c_ids[column]))
        order = np.lexsort((all_ids, -all_scores, owner))
        sizes = self.k + np.bincount(place, minlength=len(rows))
        first = order[(np.cumsum(sizes) - sizes)[:, None] + np.arange(self.k)]
        held[rows], ids[rows] = all_scores[first], all_ids[first]

    def spill(self, everything: bool = False) -> Iterator[pa.RecordBatch]:
        while self.held and (everything or self.size > self.limit):
            _, (q_ids, ids, scores) = self.held.popitem(last=False)
            self.size -= 16 * len(q_ids) * self.k
            hit = scores > -np.inf
            if hit.any():
                yield pa.RecordBatch.from_pydict({"q_id": np.repeat(q_ids, hit.sum(axis=1)), "chunk_id": ids[hit], "score": scores[hit]})


def best_rows(hits: DataFrame, k: int) -> DataFrame:
    """Best ``k`` chunks per question of what the tasks sent, first per share of the chunks, then of the shares."""
    order = [F.desc("score"), F.asc("chunk_id")]
    shares = hits.withColumn("_share", F.pmod(F.xxhash64("chunk_id"), F.lit(SHARES)).cast("int"))
    return top_n(top_n(shares, ["q_id", "_share"], order, k, "_rank").drop("_share", "_rank"), ["q_id"], order, k)


# ---- vectors ----

def _matrix(column: pa.Array) -> np.ndarray:
    m = np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)
    return m / np.sqrt(np.maximum((m * m).sum(axis=1, keepdims=True), 1e-300))


def _pack_vectors(df: DataFrame, id_col: str, prefix: str, rows: int | None) -> DataFrame:
    """(kb_id, <prefix>_ids, <prefix>_vectors): unit vectors of one knowledge base side by side, at most ``rows`` or ``BLOCK_BYTES`` of them, packed where they lie."""
    block_bytes = BLOCK_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            kbs, ids = np.asarray(batch.column("kb_id")), np.asarray(batch.column(id_col))
            width = max(1, len(batch.column("vector")[0]))
            most = rows or max(1, block_bytes // (8 * width))
            order = np.argsort(kbs, kind="stable")
            cuts = np.flatnonzero(np.diff(kbs[order])) + 1
            for mine in np.split(order, cuts):
                for at in range(0, len(mine), most):
                    part = mine[at:at + most]
                    m = _matrix(batch.column("vector").take(pa.array(part)))
                    yield pa.RecordBatch.from_pydict({"kb_id": pa.array([int(kbs[part[0]])], pa.int64()), f"{prefix}_ids": pa.array([ids[part].astype(np.int64).tobytes()], pa.binary()),
                                                      f"{prefix}_vectors": pa.array([m.tobytes()], pa.binary())})

    slim = df.select(F.col("kb_id").cast("bigint"), F.col(id_col).cast("bigint"), "vector").filter(f"kb_id is not null and {id_col} is not null and size(vector) > 0")
    return slim.mapInArrow(run, f"kb_id bigint, {prefix}_ids binary, {prefix}_vectors binary")


def _tile_by_tile(tiles: DataFrame, blocks: DataFrame) -> DataFrame:
    """Every tile with every block of its knowledge base, in shares of both. A task meets all blocks of a share with one tile, then with the next: the join
    streams its left side, so a tile leaves the memory of the best only when it is done and gives ``k`` rows per question and share of the blocks."""
    def share(c: str, number: int) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(number)).cast("int")

    def every(number: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(number - 1)))

    left = tiles.withColumn("_tile", share("q_ids", TILE_SHARES)).withColumn("_block", every(BLOCK_SHARES))
    right = blocks.withColumn("_block", share("c_ids", BLOCK_SHARES)).withColumn("_tile", every(TILE_SHARES))
    return left.join(right.hint("merge"), ["kb_id", "_tile", "_block"]).drop("_tile", "_block")


def vector_topk(questions: DataFrame, chunks: DataFrame, k: int = RECALL_K) -> DataFrame:
    """Exact best ``k`` chunks per question by cosine inside the question's knowledge base.

    questions (q_id, kb_id, vector), chunks (kb_id, chunk_id, vector) -> (q_id, chunk_id, score, rank). Rows with a null id or an empty or null vector take no part.
    The vector table is read once; it is not shuffled as long as the questions can be broadcast.
    """
    blocks, tiles = _pack_vectors(chunks, "chunk_id", "c", None), _pack_vectors(questions, "q_id", "q", TILE_QUESTIONS)
    if estimated_bytes(tiles) * TERM_GROWTH <= broadcast_limit(tiles):
        pairs = blocks.join(F.broadcast(tiles), "kb_id")
    else:
        pairs = _tile_by_tile(_pack_vectors(questions, "q_id", "q", MANY_QUESTIONS), blocks)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(k)
        for batch in batches:
            for kb, c_ids, c_vectors, q_ids, q_vectors in zip(*(batch.column(c) for c in ("kb_id", "c_ids", "c_vectors", "q_ids", "q_vectors")), strict=True):
                chunk_ids, asked_ids = np.frombuffer(c_ids.as_buffer(), np.int64), np.frombuffer(q_ids.as_buffer(), np.int64)
                stored = np.frombuffer(c_vectors.as_buffer(), np.float64).reshape(len(chunk_ids), -1)
                asked = np.frombuffer(q_vectors.as_buffer(), np.float64).reshape(len(asked_ids), -1)
                best.add((kb.as_py(), q_ids.as_py()), asked_ids, chunk_ids, asked @ stored.T, SCORE_DIGITS)
                yield from best.spill()
        yield from best.spill(everything=True)

    return best_rows(pairs.mapInArrow(scan, HITS), k)


# ---- terms ----

LISTS = "array<struct<term:string,bound:double,ids:array<bigint>,values:array<double>>>"


def _lists(terms: pa.Array, chunk_ids: np.ndarray, values: np.ndarray) -> pa.Array:
    """One list entry per term: its largest value, its chunks and their values."""
    coded = terms.dictionary_encode()
    codes = np.asarray(coded.indices)
    order = np.argsort(codes, kind="stable")
    starts = np.flatnonzero(np.diff(codes[order], prepend=-1))
    offsets = pa.array(np.append(starts, len(order)).astype(np.int32))
    fields = [coded.dictionary.take(pa.array(codes[order][starts])), pa.array(np.maximum.reduceat(values[order], starts)),
              pa.ListArray.from_arrays(offsets, pa.array(chunk_ids[order])), pa.ListArray.from_arrays(offsets, pa.array(values[order]))]
    entries = pa.StructArray.from_arrays(fields, names=["term", "bound", "ids", "values"])
    return pa.ListArray.from_arrays(pa.array([0, len(entries)], pa.int32()), entries)


def _cut_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings sorted by knowledge base and chunk, cut to blocks of at most ``BLOCK_CHUNKS`` whole chunks of one knowledge base."""
    def block(part: pa.Table) -> pa.RecordBatch:
        part = part.combine_chunks()
        chunk_ids = np.asarray(part["chunk_id"])
        lists = _lists(part["term"].combine_chunks(), chunk_ids, np.asarray(part["value"]))
        return pa.RecordBatch.from_arrays([pa.array([part["kb_id"][0].as_py()], pa.int64()), pa.array([int(chunk_ids[0])], pa.int64()), lists], names=["kb_id", "block", "lists"])

    rest: pa.Table | None = None
    for batch in batches:
        if not len(batch):
            continue
        rest = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        kbs, chunk_ids = np.asarray(rest["kb_id"]), np.asarray(rest["chunk_id"])
        fresh_kb = np.diff(kbs, prepend=kbs[0]) != 0
        fresh = (np.diff(chunk_ids, prepend=chunk_ids[0]) != 0) | fresh_kb
        number = np.cumsum(fresh)
        first_of_kb = np.maximum.accumulate(np.where(fresh_kb, number, 0))
        cut = np.flatnonzero(fresh & ((number - first_of_kb) % BLOCK_CHUNKS == 0))
        at = 0
        for end in cut.tolist():
            yield block(rest.slice(at, end - at))
            at = end
        rest = rest.slice(at)
    if rest is not None and len(rest):
        yield block(rest)


def _packed(postings: DataFrame) -> DataFrame:
    """(kb_id, block, lists) from postings (kb_id, chunk_id, term, value): dealt out by chunk, so a hot knowledge base is spread."""
    slim = postings.select(F.col("kb_id").cast("bigint"), F.col("chunk_id").cast("bigint"), "term", F.col("value").cast("double")).dropna()
    return slim.repartition("kb_id", "chunk_id").sortWithinPartitions("kb_id", "chunk_id").mapInArrow(_cut_blocks, f"kb_id bigint, block bigint, lists {LISTS}")


def block_index(postings: DataFrame, value: str = "tf") -> DataFrame:
    """Inverted index in blocks of chunks for storing: (kb_id, block, term, bound, ids, values); ``bound`` is the term's largest value in the block."""
    packed = _packed(postings.select("kb_id", "chunk_id", "term", F.col(value).alias("value")))
    return packed.select("kb_id", "block", F.explode("lists").alias("e")).select("kb_id", "block", "e.*")


def _tiles(terms: DataFrame) -> DataFrame:
    """(kb_id, q_ids, of, terms, weights): the terms of at most ``TILE_QUESTIONS`` questions of one knowledge base, ``of`` telling the question of each."""
    asked = terms.groupBy("kb_id", "q_id").agg(F.collect_list(F.struct("term", "weight")).alias("terms"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kbs = np.asarray(batch.column("kb_id"))
            order = np.argsort(kbs, kind="stable")
            for mine in np.split(order, np.flatnonzero(np.diff(kbs[order])) + 1):
                for at in range(0, len(mine), TILE_QUESTIONS):
                    part = batch.take(pa.array(mine[at:at + TILE_QUESTIONS]))
                    lists = part.column("terms")
                    entries = lists.flatten()
                    of = np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths()))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([part.column("kb_id")[0].as_py()], pa.int64()), pa.array([np.asarray(part.column("q_id")).astype(np.int64).tobytes()], pa.binary()),
                         *[pa.ListArray.from_arrays(pa.array([0, len(entries)], pa.int32()), x) for x in (pa.array(of.astype(np.int32)), entries.field("term"), entries.field("weight"))]],
                        names=["kb_id", "q_ids", "of", "terms", "weights"])

    slim = asked.select(F.col("kb_id").cast("bigint"), F.col("q_id").cast("bigint"), "terms").filter("kb_id is not null and q_id is not null")
    return slim.mapInArrow(run, "kb_id bigint, q_ids binary, of array<int>, terms array<string>, weights array<double>")


def block_topk(terms: DataFrame, blocks: DataFrame, k: int = RECALL_K, scale: float = 1.0) -> DataFrame:
    """Best ``k`` chunks per question by ``scale`` times the sum of weight times value over its terms.

    terms (q_id, kb_id, term, weight), blocks (kb_id, block, lists). Weights and values are positive. A question whose bound in a block, the sum of weight times
    ``bound``, is under its k-th best score so far skips the block; chunks are scored only for the other questions.
    """
    pairs = salted_join(blocks, _tiles(terms), ["kb_id"], F.col("block"), TERM_GROWTH, SHARES)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, open_block, held = Best(k), None, None
        for batch in batches:
            lists = batch.column("lists")
            for i in range(len(batch)):
                kb, name = batch.column("kb_id")[i].as_py(), batch.column("block")[i].as_py()
                if open_block != (kb, name):
                    entries = lists[i].values
                    ids = entries.field("ids")
                    chunk_ids, columns = np.unique(np.asarray(ids.flatten()), return_inverse=True)
                    ends = np.cumsum(np.asarray(ids.value_lengths()))
                    held = (chunk_ids, columns, np.asarray(entries.field("values").flatten()), np.concatenate(([0], ends)),
                            {t: j for j, t in enumerate(entries.field("term").to_pylist())}, np.asarray(entries.field("bound")))
                    open_block = (kb, name)
                q_ids = np.frombuffer(batch.column("q_ids")[i].as_buffer(), np.int64)
                key = (kb, batch.column("q_ids")[i].as_py())
                _score_block(best, key, q_ids, *(batch.column(c)[i].values for c in ("of", "terms", "weights")), *held, scale)
                yield from best.spill()
        yield from best.spill(everything=True)

    return best_rows(pairs.mapInArrow(scan, HITS), k)


def _score_block(best: Best, key: tuple, q_ids: np.ndarray, of: pa.Array, terms: pa.Array, weights: pa.Array, chunk_ids: np.ndarray, columns: np.ndarray,
                 values: np.ndarray, offsets: np.ndarray, numbers: dict[str, int], bounds: np.ndarray, scale: float) -> None:
    number = np.array([numbers.get(t, -1) for t in terms.to_pylist()], np.int64)
    met = np.flatnonzero(number >= 0)
    if not len(met):
        return
    of, weights, number = np.asarray(of)[met], np.asarray(weights)[met], number[met]
    bound = np.bincount(of, weights * bounds[number], len(q_ids)) * scale
    active = (bound > 0) & (bound + 10.0 ** -SCORE_DIGITS >= best.state(key, q_ids)[2][:, -1])
    use = active[of]
    if not use.any():
        return
    of, weights, number = of[use], weights[use], number[use]
    rows = np.flatnonzero(active)
    row_of = np.cumsum(active) - 1
    sums = np.zeros((len(rows), len(chunk_ids)))
    order = np.argsort(number, kind="stable")
    for mine in np.split(order, np.flatnonzero(np.diff(number[order])) + 1):
        a, b = offsets[number[mine[0]]], offsets[number[mine[0]] + 1]
        sums[np.ix_(row_of[of[mine]], columns[a:b])] += np.outer(weights[mine], values[a:b])
    scores = np.full((len(q_ids), len(chunk_ids)), -np.inf)
    scores[rows] = np.where(sums > 0, np.round(sums * scale, SCORE_DIGITS), -np.inf)
    best.add(key, q_ids, chunk_ids, scores)


def keyword_topk(terms: DataFrame, postings: DataFrame, k: int = RECALL_K, weight: float = COVER_WEIGHT) -> DataFrame:
    """Best ``k`` chunks per question by matched term occurrences times ``weight``.

    terms (q_id, kb_id, term); postings (kb_id, chunk_id, term, tf) or their :func:`block_index` -> (q_id, chunk_id, score, rank). Lists of terms that nobody asks
    for are dropped before anything is shuffled.
    """
    asked = asked_only(postings, terms)
    if "block" in postings.columns:
        blocks = asked.groupBy("kb_id", "block").agg(F.collect_list(F.struct("term", "bound", "ids", "values")).alias("lists"))
    else:
        blocks = _packed(asked.select("kb_id", "chunk_id", "term", F.col("tf").alias("value")))
    return block_topk(terms.select("q_id", "kb_id", "term", F.lit(1.0).alias("weight")), blocks, k, weight)


def bm25_topk(terms: DataFrame, postings: DataFrame, k: int = RECALL_K, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Same recall ranked by BM25 (Robertson and Zaragoza 2009) per knowledge base: the idf weighs a term, the rest is a posting's value."""
    lengths = postings.groupBy("kb_id", "chunk_id").agg(F.sum("tf").alias("len"))
    stats = lengths.groupBy("kb_id").agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg_len"))
    asked = asked_only(postings, terms)
    df = asked.groupBy("kb_id", "term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    rated = terms.join(df, ["kb_id", "term"]).join(stats, "kb_id").select("q_id", "kb_id", "term", idf.alias("weight"))
    rest = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    valued = asked.join(lengths, ["kb_id", "chunk_id"]).join(stats, "kb_id").select("kb_id", "chunk_id", "term", rest.alias("value"))
    return block_topk(rated, _packed(valued), k)
