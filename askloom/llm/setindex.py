"""Index lists over sets: packed postings, lists of keys that several sets share, and links resolved over the lists.

A posting is (key, set). Postings travel packed per bucket of the key space, so that the many keys that only one set has never become
rows. Sets that share a key within one slice of a task are known to share it and go straight to the lists; only the first of them
is sent on. A key that a third of all sets hold therefore sends one posting per slice.

A key is a function of (class, position, lane); a lane is a 32-bit hash of what a set holds at that position. The lanes of two sets tell
in which list they meet first, and parity bitmaps bound the elements they differ in, so a pair is judged before it becomes a row. The pairs of
sets and leaders, too, meet with sizes and bitmaps first; only sets of pairs that these allow have their contents moved.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from askloom.llm.common import drop, lean, mix, partitions, store
from askloom.llm.components import components

BUCKETS_PER_PARTITION = 4
PAIRS_PER_TASK_GROUP = 64
"""Comparisons with one set that are dealt out together."""
TILE = 1024
"""Members of a list that meet in one tile; a longer list is cut into shares, and every two shares meet in a tile of their own."""
PAIRS_AT_ONCE = 1 << 17
LEADERS = 4
"""Leaders that a list elects and that a set asks at first."""
WIDE = 16
"""Positions whose lanes travel with a set."""
BITS = 1024
"""Length of the parity bitmap of a set."""
POSTINGS = "bucket int, keys binary, sets binary, numbers binary, shared boolean"
GROUPS = "bucket int, keys binary, counts binary, sets binary, brief binary, numbers binary"
"""Postings of sets that stand together at one place of a text, a key and a count for each place, with the :func:`brief_bitmaps` of the sets."""
LISTS = "key long, set_id long"
LANES = "set_id long, cls int, own boolean, size long, wide binary, parity binary"
CANDIDATES = "a long, b long"
ITEMS = "set_id long, content string, size long, parity binary, long binary"
LONG, LONG_BITS = 512, 8192
"""Sets of more elements than this, whose short bitmaps fill up, have a second one of so many bits."""
FILTER_BITS = 1 << 23
"""Length of the bitmap of the sets that a step asks for, one megabyte; more sets only let more through."""
LOCAL_BITS = 40
GROUP_PAIRS_AT_ONCE = 1 << 20


def list_keys(cls: np.ndarray, place: np.ndarray, lane: np.ndarray) -> np.ndarray:
    """Key of the list of ``lane`` at ``place``; its last byte is the class."""
    with np.errstate(over="ignore"):
        key = mix(mix(place.astype(np.uint64) + (cls.astype(np.uint64) << np.uint64(40))) + lane.astype(np.uint64))
    return (key & ~np.uint64(255)) | cls.astype(np.uint64)


def wide_lanes(lanes: np.ndarray) -> list[bytes]:
    """The first lanes of each row (0: nothing at that position)."""
    wide = np.zeros((len(lanes), WIDE), np.uint32)
    wide[:, :lanes.shape[1]] = lanes[:, :WIDE]
    return [w.tobytes() for w in wide]


def parity_bitmaps(tokens: np.ndarray, offsets: np.ndarray, length: int = BITS) -> list[bytes]:
    """A bitmap per set in which every element flips one bit: two sets differ in at least as many elements as their bitmaps in bits."""
    sets = len(offsets) - 1
    at = np.repeat(np.arange(sets), np.diff(offsets)) * length + (mix(tokens) % np.uint64(length)).astype(np.int64)
    bits = (np.bincount(at, minlength=sets * length) & 1).astype(np.uint8).reshape(sets, length)
    return [b.tobytes() for b in np.packbits(bits, axis=1)]


def brief_bitmaps(tokens: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Parity bitmaps of 32 bits of sets with elements."""
    return np.bitwise_xor.reduceat(np.uint32(1) << (mix(tokens) >> np.uint64(59)).astype(np.uint32), offsets[:-1])


def most_differing(percent: int, size: int) -> int:
    """Most elements in which two linked sets of at most ``size`` elements differ."""
    return 2 * size * (100 - percent) // (100 + percent)


def sketches(tokens: np.ndarray, offsets: np.ndarray, which: np.ndarray) -> list[pa.Array]:
    """(size, parity, long) of the sets numbered ``which``."""
    sizes = np.diff(offsets)[which]
    own = [tokens[offsets[i]:offsets[i + 1]] for i in which.tolist()]
    parity = parity_bitmaps(np.concatenate([tokens[:0], *own]), np.concatenate(([0], np.cumsum(sizes))))
    wide = [parity_bitmaps(t, np.array([0, len(t)]), LONG_BITS)[0] if len(t) > LONG else None for t in own]
    return [pa.array(sizes), pa.array(parity, pa.binary()), pa.array(wide, pa.binary())]


def pack(keys: np.ndarray, sets: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes, bytes, bytes, bool]]:
    """Rows of :data:`POSTINGS` for the postings of one slice; five bytes of a key are kept beside its bucket."""
    bucket = ((keys >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)
    order = np.argsort(bucket.astype(np.uint16) if buckets < 1 << 16 else bucket, kind="stable")
    local = keys[order] & np.uint64((1 << LOCAL_BITS) - 1)
    sets = sets[order]
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(bucket[order])) + 1, [len(order)])) if len(order) else np.zeros(1, int)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        number, k, s = int(bucket[order[a]]), local[a:b], sets[a:b]
        by = np.argsort(k, kind="stable")
        same = np.concatenate(([False], k[by][1:] == k[by][:-1]))
        if same.any():
            both = same | np.concatenate((same[1:], [False]))
            yield _row(number, k[by][both], s[by][both], True)
            first = np.sort(by[~same])
            k, s = k[first], s[first]
        yield _row(number, k, s, False)


def _row(bucket: int, keys: np.ndarray, sets: np.ndarray, shared: bool) -> tuple[int, bytes, bytes, bytes, bool]:
    known, at = np.unique(sets, return_inverse=True)
    short = np.ascontiguousarray(keys).view(np.uint8).reshape(-1, 8)[:, :5].tobytes()
    return bucket, short, known.astype(np.int64).tobytes(), at.astype(np.uint32 if len(known) > 65535 else np.uint16).tobytes(), shared


def _unpack(keys: bytes, sets: bytes, numbers: bytes) -> tuple[np.ndarray, np.ndarray]:
    short = np.frombuffer(keys, np.uint8).reshape(-1, 5)
    full = np.zeros((len(short), 8), np.uint8)
    full[:, :5] = short
    known = np.frombuffer(sets, np.int64)
    return full.view(np.int64).ravel(), known[np.frombuffer(numbers, np.uint32 if len(known) > 65535 else np.uint16)]


def posting_batch(rows: list[tuple]) -> pa.RecordBatch:
    bucket, keys, sets, numbers, shared = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(keys, pa.binary()), pa.array(sets, pa.binary()),
                                       pa.array(numbers, pa.binary()), pa.array(shared, pa.bool_())],
                                      ["bucket", "keys", "sets", "numbers", "shared"])


def bucket_count(df: DataFrame) -> int:
    return partitions(df.sparkSession) * BUCKETS_PER_PARTITION


def _shared_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

    def out(bucket: int, keys: np.ndarray, sets: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys + (np.int64(bucket) << LOCAL_BITS)), pa.array(sets)], ["key", "set_id"])

    for batch in batches:
        for bucket, keys, sets, numbers, shared in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            k, s = _unpack(keys, sets, numbers)
            if shared:
                yield out(bucket, k, s)
            else:
                held.setdefault(bucket, []).append((k, s))
    for bucket in list(held):
        parts = held.pop(bucket)
        k, s = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        order = np.lexsort((s, k))
        k, s = k[order], s[order]
        fresh = np.ones(len(k), bool)
        fresh[1:] = (k[1:] != k[:-1]) | (s[1:] != s[:-1])
        k, s = k[fresh], s[fresh]
        same = np.concatenate(([False], k[1:] == k[:-1]))
        both = same | np.concatenate((same[1:], [False]))
        for a in range(0, int(both.sum()), 1 << 16):
            yield out(bucket, k[both][a:a + (1 << 16)], s[both][a:a + (1 << 16)])


def shared_lists(postings: DataFrame, name: str) -> DataFrame:
    """(key, set_id) of every key that two different sets hold, stored. Postings of equal sets are one posting."""
    lists = postings.repartition(partitions(postings.sparkSession), "bucket").mapInArrow(lean(_shared_lists), LISTS)
    return store(lists, f"{name}-lists")


def _members(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Places of the members of groups that begin at ``starts``."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))


def _group_prints(counts: np.ndarray, sets: np.ndarray) -> np.ndarray:
    """A fingerprint per group; groups of the same sets have equal ones."""
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(sets.view(np.uint64)), dtype=np.uint64)))
        ends = np.cumsum(counts)
        return mix(sums[ends] - sums[ends - counts] + counts.astype(np.uint64))


def pack_groups(keys: np.ndarray, counts: np.ndarray, sets: np.ndarray, brief: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes, bytes, bytes, bytes, bytes]]:
    """Rows of :data:`GROUPS` for the groups of one slice: ``sets`` and ``brief`` hold ``counts`` sets for each of ``keys``, fewer than 256. Groups that repeat are one."""
    _, once = np.unique(keys ^ _group_prints(counts, sets), return_index=True)
    starts = (np.cumsum(counts) - counts)[once]
    keys, counts = keys[once], counts[once]
    bucket = ((keys >> np.uint64(LOCAL_BITS)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)
    order = np.argsort(bucket.astype(np.uint16) if buckets < 1 << 16 else bucket, kind="stable")
    bucket, starts, counts = bucket[order], starts[order], counts[order]
    local = (keys[order] & np.uint64((1 << LOCAL_BITS) - 1)).view(np.uint8).reshape(-1, 8)[:, :5]
    members, ends = _members(starts, counts), np.cumsum(counts)
    sets, brief = sets[members], brief[members]
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(order)])) if len(order) else np.zeros(1, int)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        part = slice(int(ends[a] - counts[a]), int(ends[b - 1]))
        known, one, at = np.unique(sets[part], return_index=True, return_inverse=True)
        yield (int(bucket[a]), np.ascontiguousarray(local[a:b]).tobytes(), counts[a:b].astype(np.uint8).tobytes(), known.astype(np.int64).tobytes(),
               brief[part][one].tobytes(), at.astype(np.uint32 if len(known) > 65535 else np.uint16).tobytes())


def group_batch(rows: list[tuple]) -> pa.RecordBatch:
    bucket, *packed = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), *(pa.array(p, pa.binary()) for p in packed)], ["bucket", "keys", "counts", "sets", "brief", "numbers"])


def _unmet(keys: np.ndarray, counts: np.ndarray, sets: np.ndarray, brief: np.ndarray, differ: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(key, set) of the sets that stand in no group with some other set of their key from which their bitmaps differ in at most ``differ`` bits."""
    prints = _group_prints(counts, sets)
    order = np.lexsort((prints, keys))
    k, p = keys[order], prints[order]
    fresh = np.ones(len(k), bool)
    fresh[1:] = (k[1:] != k[:-1]) | (p[1:] != p[:-1])
    order, k = order[fresh], k[fresh]
    same = np.concatenate((np.zeros(min(len(k), 1), bool), k[1:] == k[:-1]))
    several = same | np.append(same[1:], False)[:len(same)]
    order, k = order[several], k[several]
    starts, n = (np.cumsum(counts) - counts)[order], counts[order]
    total = np.cumsum(n * n)
    begin = 0
    while begin < len(k):
        end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + GROUP_PAIRS_AT_ONCE, "right")))
        # a key is not parted
        end = int(np.searchsorted(k, k[end - 1], "right"))
        size, key = n[begin:end], np.repeat(k[begin:end], n[begin:end])
        at = _members(starts[begin:end], size)
        begin = end
        by = np.lexsort((sets[at], key))
        key, member = key[by], sets[at][by]
        fresh = np.ones(len(by), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (member[1:] != member[:-1])
        number = np.empty(len(by), np.int64)
        number[by] = np.cumsum(fresh) - 1
        key, member, bits = key[fresh], member[fresh], brief[at][by][fresh]
        close = _close_pairs(key, bits, differ)
        if not len(close):
            continue
        # every member of a group with every one
        each = np.repeat(size, size)
        met = np.repeat(number, each) * len(key) + number[_members(np.repeat(np.cumsum(size) - size, size), each)]
        close = close[~np.isin(close, met)]
        if len(close):
            open_ = np.zeros(len(key), bool)
            open_[close // len(key)] = open_[close % len(key)] = True
            yield key[open_], member[open_]


def _close_pairs(keys: np.ndarray, bits: np.ndarray, differ: int) -> np.ndarray:
    """i * n + j for i < j of the n members of sorted ``keys`` that have one key and bitmaps that differ in at most ``differ`` bits."""
    last = np.searchsorted(keys, keys, "right")
    partners = last - np.arange(len(keys)) - 1
    total = np.cumsum(partners)
    found, start = [np.zeros(0, np.int64)], 0
    while start < len(keys):
        stop = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + GROUP_PAIRS_AT_ONCE, "right")))
        i = np.repeat(np.arange(start, stop), partners[start:stop])
        j = _members(np.arange(start, stop) + 1, partners[start:stop])
        use = np.bitwise_count(bits[i] ^ bits[j]) <= differ
        found.append(i[use] * len(keys) + j[use])
        start = stop
    return np.concatenate(found)


def _uncovered_task(differ: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, ...]]] = {}
        for batch in batches:
            for bucket, keys, counts, sets, brief, numbers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                k, s = _unpack(keys, sets, numbers)
                b = np.frombuffer(brief, np.uint32)
                held.setdefault(bucket, []).append((k, np.frombuffer(counts, np.uint8), s, b[np.frombuffer(numbers, np.uint32 if len(b) > 65535 else np.uint16)]))
        for bucket in list(held):
            keys, counts, sets, brief = (np.concatenate(c) for c in zip(*held.pop(bucket), strict=True))
            for k, s in _unmet(keys, counts.astype(np.int64), sets, brief, differ):
                yield pa.RecordBatch.from_arrays([pa.array(k + (np.int64(bucket) << LOCAL_BITS)), pa.array(s)], ["key", "set_id"])
    return run


def uncovered_lists(groups: DataFrame, differ: int, name: str) -> DataFrame:
    """(key, set_id) of the keys with two sets that stand together in no group and can differ in at most ``differ`` elements, and of those sets only, stored.
    Sets of one group have met already."""
    lists = groups.repartition(partitions(groups.sparkSession), "bucket").mapInArrow(lean(_uncovered_task(differ)), LISTS)
    return store(lists, f"{name}-lists")


def _paired(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """Join both contents to (a, b); groups of one ``b`` are dealt out in shares of bounded size."""
    share = (F.col("n") / PAIRS_PER_TASK_GROUP).cast("int")
    sizes = pairs.groupBy("b").agg(F.count("*").alias("n"))
    right = sizes.join(items.select(F.col("set_id").alias("b"), F.col("content").alias("content_b")), "b").select(
        "b", "content_b", F.explode(F.sequence(F.lit(0), share)).alias("share"))
    left = pairs.join(sizes, "b").withColumn("share", F.pmod(F.xxhash64("a"), share + 1).cast("int")).drop("n").join(
        items.select(F.col("set_id").alias("a"), F.col("content").alias("content_a")), "a")
    return left.join(right, ["b", "share"])


def _allowed(size_a: np.ndarray, size_b: np.ndarray, parity_a: np.ndarray, parity_b: np.ndarray, percent: int) -> np.ndarray:
    """Whether sizes and bitmaps leave two sets a similarity of ``percent``: linked sets differ in at least as many elements as their bitmaps in bits."""
    differ = np.bitwise_count(parity_a ^ parity_b).sum(axis=1, dtype=np.int64)
    near = 100 * np.minimum(size_a, size_b) >= percent * np.maximum(size_a, size_b)
    return near & ((100 + percent) * differ <= (100 - percent) * (size_a + size_b))


def _bitmaps(column: pa.Array | pa.ChunkedArray, length: int = BITS) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, length // 64)


def _sketch_task(percent: int):
    """Batches of (a, b, content_a, content_b) with contents (size, parity, long): the pairs that can be linked."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (size_a, bits_a, long_a), (size_b, bits_b, long_b) = (batch.column(c).flatten() for c in (2, 3))
            size_a, size_b = size_a.to_numpy(), size_b.to_numpy()
            use = _allowed(size_a, size_b, _bitmaps(bits_a), _bitmaps(bits_b), percent)
            both = np.flatnonzero(use & long_a.is_valid().to_numpy(False) & long_b.is_valid().to_numpy(False))
            for at in (both[i:i + 1024] for i in range(0, len(both), 1024)):
                use[at] = _allowed(size_a[at], size_b[at], *(_bitmaps(x.take(pa.array(at)), LONG_BITS) for x in (long_a, long_b)), percent)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(use)) for c in (0, 1)], ["a", "b"])
    return run


def _among(ids: DataFrame) -> Column:
    """Whether a row's set_id is in ``ids``; a few others pass. The driver holds one bitmap of :data:`FILTER_BITS`."""
    def spots(h: Column) -> list[Column]:
        return [F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(FILTER_BITS - 1).cast("long")) for shift in (0, 32)]

    words = ids.select(F.explode(F.array(*spots(F.xxhash64("set_id")))).alias("spot")).groupBy(F.shiftright("spot", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(spot & 63 as int))")).alias("held")).toArrow()
    bitmap = np.zeros(FILTER_BITS >> 6, np.int64)
    bitmap[words["word"].to_numpy()] = words["held"].to_numpy()
    shared = ids.sparkSession.sparkContext.broadcast(bitmap)

    @F.pandas_udf("boolean")
    def held(one: pd.Series, other: pd.Series) -> pd.Series:
        tests = [shared.value[s.to_numpy() >> 6] >> (s.to_numpy() & 63) & 1 for s in (one, other)]
        return pd.Series((tests[0] & tests[1]) == 1)

    return held(*spots(F.xxhash64("set_id")))


def _plausible(rows: pa.Table, percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs of whole tiles, ``rows`` in order of tiles: of different components, of sizes within ``percent``, with bitmaps
    that differ in no more bits than linked sets in elements, and in the first list in which the two meet."""
    key, lower, upper, comp, share, ids, size, own, cls = (
        rows[c].to_numpy() for c in ("key", "lower", "upper", "comp", "share", "set_id", "size", "own", "cls"))
    wide = np.frombuffer(b"".join(rows["wide"].to_pylist()), np.uint32).reshape(-1, WIDE)
    parity = _bitmaps(rows["parity"])
    cuts = np.flatnonzero((key[1:] != key[:-1]) | (lower[1:] != lower[:-1]) | (upper[1:] != upper[:-1])) + 1
    ends = np.repeat(np.append(cuts, len(key)), np.diff(np.concatenate(([0], cuts, [len(key)]))))
    partners = ends - np.arange(len(key)) - 1
    total = np.cumsum(partners)
    start = 0
    while start < len(key):
        stop = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + PAIRS_AT_ONCE, "right")))
        number = partners[start:stop]
        a = np.repeat(np.arange(start, stop), number)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(number) - number, number)
        start = stop
        use = (comp[a] != comp[b]) & (own[a] | own[b]) & ((lower[a] == upper[a]) | (share[a] != share[b]))
        use &= 100 * np.minimum(size[a], size[b]) >= percent * np.maximum(size[a], size[b])
        a, b = a[use], b[use]
        same = (wide[a] == wide[b]) & (wide[a] != 0)
        first = same.argmax(axis=1)
        # a list's key keeps the low bits; a bucket stands for the others
        meets = (list_keys(cls[a], first, wide[a, first]).view(np.int64) ^ key[a]) & ((1 << LOCAL_BITS) - 1) == 0
        use = ~same.any(axis=1) | meets
        a, b = a[use], b[use]
        use = _allowed(size[a], size[b], parity[a], parity[b], percent)
        a, b = ids[a[use]], ids[b[use]]
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def _tile_task(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            key, lower, upper = (held[c].to_numpy() for c in ("key", "lower", "upper"))
            # the last tile may go on in the next batch
            before = np.flatnonzero((key != key[-1]) | (lower != lower[-1]) | (upper != upper[-1]))
            if len(before):
                last = int(before[-1]) + 1
                yield from _plausible(held.slice(0, last), percent)
                held = held.slice(last)
        if held is not None and held.num_rows:
            yield from _plausible(held, percent)
    return run


def _candidates(open_lists: DataFrame, lanes: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the open lists that their bitmaps do not rule out."""
    shares = F.ceil(F.col("members") / TILE).cast("int")
    dealt = open_lists.withColumn("cls", F.expr("CAST(key & 255 AS INT)")).withColumn(
        "share", F.pmod(F.xxhash64("set_id"), shares).cast("int")).select(
        "key", "cls", "set_id", "comp", "share", F.explode(F.sequence(F.lit(0), shares - 1)).alias("other"))
    rows = dealt.join(lanes, ["set_id", "cls"]).select(
        "key", F.least("share", "other").alias("lower"), F.greatest("share", "other").alias("upper"), "share", "set_id", "comp", "cls", "own", "size",
        "wide", "parity")
    number = partitions(open_lists.sparkSession)
    tiles = rows.repartition(number, "key", "lower", "upper").sortWithinPartitions("key", "lower", "upper")
    return tiles.mapInArrow(lean(_tile_task(percent)), CANDIDATES).distinct()


def resolve(lists: DataFrame, contents: Callable[[DataFrame], DataFrame], lanes: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
            compare: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], percent: int, name: str, known: DataFrame | None = None,
            valid: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(set_id, component) of all sets with a link: two sets that share a list, compared by ``compare``.

    ``contents(ids)`` gives :data:`ITEMS` for the ids of the lists. ``lanes`` turns batches of (set_id, content) into :data:`LANES`, a row
    for each class a set posts in: own tells its own class. ``compare`` turns batches of (a, b, content_a, content_b) into (a, b, similarity, linked).
    ``known`` are links (a, b) found before, and ``valid`` keeps those of the linked pairs that count.

    First every set is compared with the leader it meets in most lists, then with the next few that are still in another component; its answers are then those of
    their component. A list whose
    members are all in one component is finished: its other pairs can't change any answer. In the others, pairs of different components whose
    bitmaps allow a link are compared, each once. Nothing is left out but pairs that can't be linked.
    """
    heads = [F.min(F.struct(F.xxhash64("set_id", F.lit(seed)).alias("h"), "set_id")).getField("set_id") for seed in range(LEADERS)]
    elected = lists.groupBy("key").agg(F.array_distinct(F.array(*heads)).alias("heads"))
    met = lists.join(elected, "key").select(F.col("set_id").alias("a"), F.explode("heads").alias("b")).filter("a <> b").groupBy("a", "b").agg(
        F.count("*").alias("common"))
    rank = F.row_number().over(W.partitionBy("a").orderBy(F.desc("common"), "b"))
    led = store(met.withColumn("rank", rank).filter(F.col("rank") <= LEADERS).select("a", "b", "rank"), f"{name}-led")

    def judged(pairs: DataFrame, step: str) -> DataFrame:
        rows = _paired(pairs, items.select("set_id", F.struct("size", "parity", "long").alias("content"))).select("a", "b", "content_a", "content_b")
        possible = store(rows.mapInArrow(lean(_sketch_task(percent)), CANDIDATES), f"{name}-{step}-possible")
        asked = items.filter(_among(possible.select(F.explode(F.array("a", "b")).alias("set_id")))).select("set_id", "content")
        rows = _paired(possible, asked).select("a", "b", "content_a", "content_b")
        close = rows.mapInArrow(lean(compare), "a long, b long, similarity double, linked boolean").filter("linked")
        found = store(valid(close) if valid else close, f"{name}-{step}")
        drop(possible)
        return found

    items = store(contents(lists.select("set_id").distinct()), f"{name}-items")
    first = judged(led.filter("rank = 1").select("a", "b"), "first")
    sure = first.select("a", "b").union(known.select("a", "b")) if known else first.select("a", "b")
    comps = store(components(sure, "a", "b", name).withColumnRenamed("node", "set_id"), f"{name}-comps")
    # the other leaders are asked only by sets that the first answer did not join to them
    of_a, of_b = (comps.select(F.col("set_id").alias(c), F.col("component").alias(f"comp_{c}")) for c in "ab")
    rest = led.filter("rank > 1").join(of_a, "a", "left").join(of_b, "b", "left").filter(
        F.coalesce("comp_a", "a") != F.coalesce("comp_b", "b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    second = judged(rest, "second")
    drop(led)
    linked = store(sure.union(second.select("a", "b")), f"{name}-linked")
    drop(comps, first, second)
    comps = store(components(linked, "a", "b", name).withColumnRenamed("node", "set_id"), f"{name}-comps")
    labelled = lists.join(comps, "set_id", "left").withColumn("comp", F.coalesce("component", "set_id")).drop("component")
    state = labelled.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("members"))
    open_lists = store(labelled.join(state.filter("lo <> hi").select("key", "members"), "key"), f"{name}-open")
    drop(comps)
    # only sets of open lists need lanes; a few others do no harm
    waiting = items.filter(_among(open_lists)).select("set_id", "content")
    sides = store(waiting.mapInArrow(lean(lanes), LANES), f"{name}-lanes")
    pairs = store(_candidates(open_lists, sides, percent), f"{name}-pairs")
    drop(sides, open_lists)
    more = judged(pairs, "more")
    edges = store(linked.union(more.select("a", "b")), f"{name}-edges")
    drop(items, pairs, more, linked)
    return components(edges, "a", "b", name).withColumnRenamed("node", "set_id")
