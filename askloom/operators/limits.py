"""Rate limits over event tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askloom.functions.ranking import nth_row
from askloom.session import materialize

# ---- fixed values ----
DAILY_LIMIT = 50
ANCHORED_LIMIT = 10
ANCHORED_WINDOW_SECONDS = 3600
# ---- end of fixed values ----

def limit_per_day(events: DataFrame, key: str, n: int = DAILY_LIMIT, ts: str = "ts", event_id: str = "event_id") -> DataFrame:
    """Adds ``day`` and ``allowed``: the first ``n`` hits of a key on a calendar day.

    Only the ``n``-th hit per key and day is looked up, which Spark cuts per task, so a hot key is never sorted
    in one place.
    """
    dated = events.withColumn("day", F.to_date(ts))
    last = nth_row(dated, [key, "day"], [F.asc(ts), F.asc(event_id)], n, [ts, event_id]).select(
        key, "day", F.struct(F.col(ts).alias("t"), F.col(event_id).alias("i")).alias("_last"))
    at = F.struct(F.col(ts).alias("t"), F.col(event_id).alias("i"))
    return dated.join(last, [key, "day"], "left").withColumn("allowed", F.coalesce(at <= F.col("_last"), F.lit(True))).drop("_last")


def limit_anchored(events: DataFrame, key: str, n: int = ANCHORED_LIMIT, window_seconds: int = ANCHORED_WINDOW_SECONDS,
                   ts: str = "ts", event_id: str = "event_id") -> DataFrame:
    """Adds ``anchor`` (first hit of the running window), ``hit_no`` in it and ``allowed`` = ``hit_no <= n``.

    A window starts at the hit that finds none open and lasts ``window_seconds``; rejected hits count too. Hits of one time are taken by id. A hit without key
    or time passes: it is allowed and has neither anchor nor number. Rows travel whole, so ids may repeat.

    Hits are range-sorted by (key, time, id), so segments of a key have borders where its hits are dense and a burst inside one window is cut as well:

    1. of keys that run over several segments, each segment tells, for every hit that could open its first window, where its last window would start;
    2. these functions are chained along the key: anchor in, anchor out;
    3. each segment numbers its hits as a stream, from the window that is open when it begins.

    There are fewer such keys than partitions. A segment's function has one piece per different time in its first window at most.
    """
    width = window_seconds * 1_000_000
    spark = events.sparkSession
    names = [f"c{i}" for i in range(len(events.columns))]
    named = dict(zip(events.columns, names, strict=True))
    tie = named[event_id]
    timed = events.toDF(*names).withColumns({"_key": F.col(named[key]), "_us": F.unix_micros(F.col(named[ts]).cast("timestamp"))})
    valid = timed.filter("_key is not null and _us is not null").withColumn("_tie", F.monotonically_increasing_id())
    kind = valid.schema["_key"].dataType.simpleString()
    shares = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["_key", "_us", tie]
    hits = materialize(valid.repartitionByRange(shares, *order, "_tie").drop("_tie").withColumn("_seg", F.spark_partition_id()), "limit-hits")
    spans = hits.groupBy("_key").agg(F.min("_seg").alias("a"), F.max("_seg").alias("b")).filter("a < b").select("_key")

    def summarize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (k, seg), us in _times(batches):
            starts, at = np.unique(us, return_index=True)
            then = np.searchsorted(starts, starts + width)
            last = np.where(then < len(starts), then, np.arange(len(starts)))
            while True:
                step = last[last]
                if np.array_equal(step, last):
                    break
                last = step
            entries = int(np.searchsorted(starts, starts[0] + width)) + 1
            entry, end = starts[:entries], starts[last[:entries]]
            turn = np.flatnonzero(np.append(end[1:] != end[:-1], True))
            yield pa.RecordBatch.from_pydict({"_key": [k], "_seg": pa.array([seg], pa.int32()), "hits": [len(us)], "last_us": [int(us[-1])], "entry": [entry[turn]], "end": [end[turn]],
                                              "tail": [(len(us) - at[last[:entries][turn]]).astype(np.int64)]})

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, anchor, count = object(), None, 0
        for batch in batches:
            opened: list[int | None] = []
            counts: list[int] = []
            for i in range(len(batch)):
                k, hits, last_us = (batch.column(c)[i].as_py() for c in ("_key", "hits", "last_us"))
                entry, end, tail = (np.asarray(batch.column(c)[i].values) for c in ("entry", "end", "tail"))
                if k != current:
                    current, anchor, count = k, None, 0
                opened.append(anchor)
                counts.append(count)
                if anchor is not None and last_us < anchor + width:
                    count += hits
                    continue
                piece = 0 if anchor is None else int(np.searchsorted(entry, anchor + width))
                anchor, count = int(end[piece]), int(tail[piece])
            yield pa.RecordBatch.from_arrays([batch.column("_key"), batch.column("_seg"), pa.array(opened, pa.int64()), pa.array(counts, pa.int64())],
                                             names=["_key", "_seg", "_opened", "_before"])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, anchor, count = None, None, 0
        for batch in batches:
            us, opened, before = np.asarray(batch.column("_us")), batch.column("_opened"), batch.column("_before")
            anchors, numbers = np.empty(len(us), np.int64), np.empty(len(us), np.int64)
            cuts = [0, *_borders(batch), len(us)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                name = (batch.column("_key")[a].as_py(), batch.column("_seg")[a].as_py())
                if name != current:
                    current, anchor, count = name, opened[a].as_py(), before[a].as_py() or 0
                while a < b:
                    if anchor is None or us[a] >= anchor + width:
                        anchor, count = int(us[a]), 0
                    end = a + int(np.searchsorted(us[a:b], anchor + width))
                    anchors[a:end], numbers[a:end] = anchor, np.arange(count + 1, count + 1 + end - a)
                    a, count = end, count + end - a
            kept = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(anchors), pa.array(numbers)], names=[*names, "_anchor", "_no"])

    summary = (hits.join(F.broadcast(spans), "_key", "left_semi").select("_key", "_seg", "_us").repartition("_key", "_seg").sortWithinPartitions("_key", "_seg", "_us")
               .mapInArrow(summarize, f"_key {kind}, _seg int, hits bigint, last_us bigint, entry array<bigint>, end array<bigint>, tail array<bigint>"))
    opened = (summary.repartition("_key").sortWithinPartitions("_key", "_seg").mapInArrow(chain, f"_key {kind}, _seg int, _opened bigint, _before bigint"))
    schema = T.StructType([*timed.select(*names).schema.fields, T.StructField("_anchor", T.LongType()), T.StructField("_no", T.LongType())])
    numbered = (hits.join(F.broadcast(opened), ["_key", "_seg"], "left").repartition("_key", "_seg").sortWithinPartitions("_key", "_seg", "_us", tie)
                .mapInArrow(number, schema))
    none = F.lit(None).cast("bigint")
    passed = timed.filter("_key is null or _us is null").select(*names, none.alias("_anchor"), none.alias("_no"))
    whole = numbered.unionByName(passed)
    given = [F.col(n).alias(c) for c, n in named.items() if c not in ("anchor", "hit_no", "allowed")]
    return whole.select(*given, F.col("_no").alias("hit_no"), F.timestamp_micros("_anchor").cast(events.schema[ts].dataType).alias("anchor"),
                        F.coalesce(F.col("_no") <= n, F.lit(True)).alias("allowed"))


def _borders(batch: pa.RecordBatch) -> list[int]:
    """Rows at which another (key, segment) begins."""
    if len(batch) < 2:
        return []
    changed = np.zeros(len(batch) - 1, bool)
    for name in ("_key", "_seg"):
        column = batch.column(name)
        changed |= np.asarray(pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False), dtype=bool)
    return (np.flatnonzero(changed) + 1).tolist()


def _times(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, np.ndarray]]:
    """((key, segment), times) of sorted batches, joined over batch borders."""
    open_name, parts = None, []
    for batch in batches:
        us = np.asarray(batch.column("_us"))
        cuts = [0, *_borders(batch), len(us)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            name = (batch.column("_key")[a].as_py(), batch.column("_seg")[a].as_py())
            if name != open_name:
                if parts:
                    yield open_name, np.concatenate(parts)
                open_name, parts = name, []
            parts.append(us[a:b])
    if parts:
        yield open_name, np.concatenate(parts)
