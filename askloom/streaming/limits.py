"""The anchored rate limit as a stateful stream."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from askloom.operators.limits import ANCHORED_LIMIT, ANCHORED_WINDOW_SECONDS

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class AnchoredWindow(StatefulProcessor):
    """State per key: the open window's first hit, its hits so far and the newest hit. With ``expire`` it ends when a window and the lateness have passed since its
    last change; otherwise an idle key keeps its three numbers in the state store."""

    def __init__(self, n: int, window_seconds: int, lateness_seconds: int, expire: bool = False):
        self.n, self.width, self.late, self.expire = n, window_seconds * 1_000_000, lateness_seconds * 1_000_000, expire

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.window = handle.getValueState("window", "anchor bigint, hits bigint, newest bigint",
                                           ttlDurationMs=(self.width + self.late) // 1000 if self.expire else None)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        hits = pd.concat(list(rows), ignore_index=True).sort_values(["us", "event_id"], kind="stable")
        us = hits["us"].to_numpy()
        anchor, count, newest = self.window.get() if self.window.exists() else (None, 0, None)
        first = 0 if newest is None else int(np.searchsorted(us, newest - self.late))
        anchors, numbers = np.full(len(us), -1, np.int64), np.zeros(len(us), np.int64)
        at = first
        while at < len(us):
            if anchor is None or us[at] >= anchor + self.width:
                anchor, count = int(us[at]), 0
            end = at + int(np.searchsorted(us[at:], anchor + self.width))
            anchors[at:end], numbers[at:end] = anchor, np.arange(count + 1, count + 1 + end - at)
            at, count = end, count + end - at
        if first < len(us):
            self.window.update((anchor, count, max(int(us[-1]), newest if newest is not None else int(us[-1]))))
        late = np.arange(len(us)) < first
        yield pd.DataFrame({"key": key[0], "event_id": hits["event_id"].to_numpy(), "anchor_us": pd.Series(anchors, dtype="Int64").mask(late),
                            "hit_no": pd.Series(numbers, dtype="Int64").mask(late), "allowed": late | (numbers <= self.n), "late": late})

    def close(self) -> None:
        pass


def use_rocksdb(spark: SparkSession) -> None:
    """Stateful processors need the RocksDB state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def limit_anchored_stream(events: DataFrame, key: str, n: int = ANCHORED_LIMIT, window_seconds: int = ANCHORED_WINDOW_SECONDS,
                          ts: str = "ts", lateness_seconds: int = 3600, expire: bool = False) -> DataFrame:
    """(key, event_id, anchor_us, hit_no, allowed, late) per hit; every hit comes out.

    Hits of a batch are taken in time order; one older than the open window counts into it. A hit more than ``lateness_seconds`` behind the newest hit of its key in
    earlier batches is ``late``: it is allowed, has no anchor or number and counts nowhere. A hit without key or time passes likewise, not flagged.
    ``expire`` is for streams that run on: idle keys leave the state by processing time. A run with ``availableNow`` would never end with it.
    """
    slim = events.select(F.col(key).cast("bigint").alias("key"), "event_id", F.unix_micros(F.col(ts).cast("timestamp")).alias("us"))
    numbered = slim.filter("key is not null and us is not null").groupBy("key").transformWithStateInPandas(
        statefulProcessor=AnchoredWindow(n, window_seconds, lateness_seconds, expire),
        outputStructType="key bigint, event_id bigint, anchor_us bigint, hit_no bigint, allowed boolean, late boolean", outputMode="Append", timeMode="ProcessingTime" if expire else "None")
    passed = slim.filter("key is null or us is null").select("key", "event_id", F.lit(None).cast("bigint").alias("anchor_us"), F.lit(None).cast("bigint").alias("hit_no"),
                                                             F.lit(True).alias("allowed"), F.lit(False).alias("late"))
    return numbered.unionByName(passed)
