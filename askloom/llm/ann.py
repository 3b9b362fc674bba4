"""Approximate nearest neighbours by cosine with balanced posting lists.

Centroids come from a bounded sample that is halved again and again at medians, so every list holds as much of the sample. A vector near a
border is posted to several lists. Of equal centroids, which many copies give, one is kept. An in-memory graph over the centroids finds a
vector's lists; a query reads all those found whose distance is within a ratio of the nearest. Lists and the queries that read them meet in blocks of bounded size, so neither a long list nor a
popular one is a task of its own size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from askloom.llm.common import store

SAMPLE = 20_000
"""Vectors the centroids are fitted on, chosen by a hash of the id."""
LIST_VECTORS = 200
"""Vectors a list is meant for; beyond ``MOST_LISTS`` lists they grow longer."""
MOST_LISTS = 2048
NEIGHBOURS = 24
BEAM_BUILD, BEAM_SEARCH = 24, 96
"""Lists looked for at first; a query whose last list is still within the ratio looks for twice as many."""
SAME = 1e-3
"""Centroids at this distance or less are one."""
MOST_REPLICAS = 6
BORDER_RATIO = 1.15
SEARCH_RATIO = 1.25
BLOCK = 2048
"""Vectors, and queries, in a block."""
NEAREST = 5
_TIE = 1e-9


def valid(vector: Column) -> Column:
    """Whether a vector takes part: not null, not empty, all components finite numbers, one of them not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def matrix(column: pa.Array) -> np.ndarray:
    """The vectors of an Arrow list column as rows; all have the same length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


def balanced_centroids(sample: np.ndarray, lists: int, seed: int = 11) -> np.ndarray:
    """Unit centroids of about ``lists`` parts of equal size: the largest part is cut at the median along its two means."""
    rng = np.random.default_rng(seed)
    parts = [np.arange(len(sample))]
    while len(parts) < lists:
        parts.sort(key=len)
        part = parts.pop()
        if len(part) < 2:
            parts.append(part)
            break
        rows = sample[part]
        ends = rows[rng.choice(len(part), 2, replace=False)]
        for _ in range(6):
            near = rows @ (ends[0] - ends[1]) >= np.median(rows @ (ends[0] - ends[1]))
            if near.all() or not near.any():
                break
            ends = np.stack([rows[near].mean(0), rows[~near].mean(0)])
        order = np.argsort(rows @ (ends[0] - ends[1]), kind="stable")
        half = len(part) // 2
        parts += [part[order[:half]], part[order[half:]]]
    centroids = np.stack([sample[p].mean(0) for p in parts])
    length = np.sqrt((centroids ** 2).sum(1))
    return (centroids[length > 1e-9] / length[length > 1e-9][:, None]).astype(np.float32) if (length > 1e-9).any() else sample[:1].astype(np.float32)


def different(centroids: np.ndarray) -> np.ndarray:
    """The centroids without those (nearly) equal to one kept before them."""
    rows = centroids.astype(np.float64)
    rows /= np.sqrt((rows ** 2).sum(1))[:, None]
    dropped = np.zeros(len(rows), bool)
    for i in range(len(rows)):
        if not dropped[i]:
            dropped[i + 1:] |= 2 - 2 * (rows[i + 1:] @ rows[i]) <= SAME ** 2
    return centroids[~dropped]


def centroid_graph(centroids: np.ndarray) -> np.ndarray:
    """For each centroid its nearest ones and some far ones, which make every part of the graph reachable."""
    count = len(centroids)
    close = min(NEIGHBOURS, count)
    similar = centroids @ centroids.T
    near = np.argsort(-similar, 1, kind="stable")[:, :close]
    rng = np.random.default_rng(5)
    return np.concatenate((near, rng.integers(0, count, (count, 8))), 1)


def graph_search(rows: np.ndarray, centroids: np.ndarray, graph: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, similarities) of the ``beam`` best centroids found per row, best first, by best-first search from fixed entries."""
    count, beam = len(rows), min(beam, len(centroids))
    entry = np.linspace(0, len(centroids) - 1, min(len(centroids), 2 * beam)).astype(int)
    seen = np.zeros((count, len(centroids)), bool)
    seen[:, entry] = True
    sims = rows @ centroids[entry].T
    best = np.argsort(-sims, 1, kind="stable")[:, :beam]
    found, score = entry[best], np.take_along_axis(sims, best, 1)
    spread = np.zeros(found.shape, bool)
    every = np.arange(count)
    for _ in range(4 * beam):
        todo = np.where(spread, -np.inf, score)
        at = todo.argmax(1)
        active = np.flatnonzero(todo[every, at] > -np.inf)
        if not len(active):
            break
        at = at[active]
        spread[active, at] = True
        near = graph[found[active, at]]
        fresh = ~seen[active[:, None], near]
        seen[active[:, None], near] = True
        sims = np.where(fresh, np.einsum("bd,bmd->bm", rows[active], centroids[near]), -np.inf)
        # a centroid may be drawn twice among the far ones
        order = np.sort(near, 1)
        twice = (order[:, 1:] == order[:, :-1]).any(1)
        for i in np.flatnonzero(twice):
            _, first = np.unique(near[i], return_index=True)
            again = np.ones(near.shape[1], bool)
            again[first] = False
            sims[i, again] = -np.inf
        numbers, scores = np.concatenate((found[active], near), 1), np.concatenate((score[active], sims), 1)
        marks = np.concatenate((spread[active], np.zeros(near.shape, bool)), 1)
        top = np.argsort(-scores, 1, kind="stable")[:, :beam]
        found[active], score[active] = np.take_along_axis(numbers, top, 1), np.take_along_axis(scores, top, 1)
        spread[active] = np.take_along_axis(marks, top, 1) | (score[active] == -np.inf)
    return found, score


def _distance(similarity: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * similarity))


def lists_within(rows: np.ndarray, centroids: np.ndarray, graph: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) pairs, by row: the lists a query reads, the eight nearest and all within the ratio of the nearest."""
    todo, beam, pairs = np.arange(len(rows)), BEAM_SEARCH, []
    while len(todo):
        found, score = graph_search(rows[todo], centroids, graph, beam)
        far = _distance(score)
        near = (score > -np.inf) & (far <= SEARCH_RATIO * far[:, :1] + 1e-6)
        more = near[:, -1] & (found.shape[1] < len(centroids))
        row, at = np.nonzero((near | (score > -np.inf) & (np.arange(far.shape[1]) < 8)) & ~more[:, None])
        pairs.append((todo[row], found[row, at]))
        todo, beam = todo[more], 2 * beam
    row, number = (np.concatenate(x) for x in zip(*pairs, strict=True))
    order = np.argsort(row, kind="stable")
    return row[order], number[order]


def replicas(found: np.ndarray, score: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Which of the found lists a vector is posted to: the nearest, and others about as near that no chosen one stands for."""
    far = _distance(score)
    take = np.zeros(found.shape, bool)
    take[:, 0] = True
    for j in range(1, found.shape[1]):
        near = (far[:, j] <= BORDER_RATIO * far[:, 0] + 1e-6) & (score[:, j] > -np.inf) & (take.sum(1) < MOST_REPLICAS)
        for i in range(j):
            both = near & take[:, i]
            if both.any():
                apart = _distance(np.einsum("bd,bd->b", centroids[found[both, i]], centroids[found[both, j]]))
                near[both] = apart >= far[both, j] * 0.7
        take[:, j] = near
    return take


def search(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", nearest: int = NEAREST) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``nearest`` vectors found for each query, best cosine first, ties to the smaller id.

    A query is not its own neighbour. Vectors that are null, empty, zero or hold a null or non-finite component take no part on either side,
    nor do rows with a null id and vectors of another length than the most frequent (the shorter of equally frequent). Of rows that repeat an id the
    smallest vector takes part. Scores are computed in double precision from the original vectors. Too few candidates
    give fewer rows, none give none.
    """
    def taking_part(df: DataFrame) -> DataFrame:
        good = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector")).filter(F.col("id").isNotNull() & valid(F.col("vector")))
        return good.groupBy("id").agg(F.min("vector").alias("vector"))

    spark = vectors.sparkSession
    base = store(taking_part(vectors), "ann-vectors")
    sizes = base.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    base = base.filter(F.size("vector") == sizes["size"])
    asked = taking_part(queries).filter(F.size("vector") == sizes["size"])
    total = sizes["count"]
    wanted = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < min(1 << 20, -(-(SAMPLE << 20) // total))
    sample = unit(np.array([r.vector for r in base.filter(wanted).select("vector").toLocalIterator()] or [base.first().vector], np.float64))
    centroids = different(balanced_centroids(sample, min(MOST_LISTS, max(1, -(-total // LIST_VECTORS)), max(1, len(sample) // 4))))
    model = spark.sparkContext.broadcast((centroids, centroid_graph(centroids)))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, graph = model.value
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                found, score = graph_search(unit(matrix(part.column(1))).astype(np.float32), held, graph, BEAM_BUILD)
                row, at = np.nonzero(replicas(found, score, held))
                yield pa.RecordBatch.from_arrays([pa.array(found[row, at].astype(np.int32)), *part.take(pa.array(row)).columns], ["list", "id", "vector"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, graph = model.value
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                row, number = lists_within(unit(matrix(part.column(1))).astype(np.float32), held, graph)
                yield pa.RecordBatch.from_arrays([pa.array(number.astype(np.int32)), *part.take(pa.array(row)).columns], ["list", "id", "vector"])

    kind = base.schema["vector"].dataType.simpleString()
    posted = store(base.mapInArrow(post, f"list int, id long, vector {kind}"), "ann-postings")
    probes = store(asked.mapInArrow(probe, f"list int, id long, vector {asked.schema['vector'].dataType.simpleString()}"), "ann-probes")

    def blocks(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))

    # one row per list, at most MOST_LISTS
    shape = F.broadcast(blocks(posted, "v_blocks").join(blocks(probes, "q_blocks"), "list"))
    number = F.pmod(F.xxhash64("id"), F.col("own")).cast("int")

    def dealt(df: DataFrame, own: str, other: str, own_name: str, other_name: str) -> DataFrame:
        cut = df.join(shape, "list").withColumn("own", F.col(own)).withColumn(own_name, number)
        return cut.select("list", own_name, F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other_name), "id", "vector")

    left = dealt(probes, "q_blocks", "v_blocks", "q_block", "v_block").groupBy("list", "q_block", "v_block")
    right = dealt(posted, "v_blocks", "q_blocks", "v_block", "q_block").select("list", "q_block", "v_block", "id", "vector").groupBy("list", "q_block", "v_block")

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        if not a.num_rows or not b.num_rows:
            return schema.empty_table()
        q_id, v_id = a["id"].to_numpy(), b["id"].to_numpy()
        q, v = matrix(a["vector"].combine_chunks()), matrix(b["vector"].combine_chunks())
        qu, vu = unit(q), unit(v)
        out = []
        for start in range(0, len(q), 256):
            sims = qu[start:start + 256] @ vu.T
            sims[q_id[start:start + 256, None] == v_id[None, :]] = -np.inf
            if len(v) > nearest:
                least = np.partition(sims, len(v) - nearest, 1)[:, len(v) - nearest]
            else:
                least = np.full(len(sims), -2.0)
            row, at = np.nonzero(sims >= np.maximum(least, -2.0)[:, None] - _TIE)
            x, y = q[row + start], v[at]
            exact = np.einsum("ij,ij->i", x, y) / (np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", y, y)))
            order = np.lexsort((v_id[at], -exact, row))
            row, at, exact = row[order], at[order], exact[order]
            begin = np.searchsorted(row, row)
            kept = np.arange(len(row)) - begin < nearest
            out.append(pa.table([q_id[start + row[kept]], v_id[at[kept]], exact[kept]], schema=schema))
        return pa.concat_tables(out)

    met = left.cogroup(right).applyInArrow(meet, "query_id long, vec_id long, score double")
    once = met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = once.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")
