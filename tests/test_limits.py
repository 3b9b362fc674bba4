"""Anchored limits: dense segments, rows without key or time, repeated ids, late hits of a stream."""

import random
from datetime import datetime, timedelta, timezone

import pandas as pd
import pytest

from askloom.operators import limits
from askloom.streaming import limits as stream

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def by_hand(rows, width, n):
    """{(key, second, id): (anchor, hit_no, allowed)} and how often."""
    out, state = [], {}
    for k, s, i in sorted((r for r in rows if r[0] is not None and r[1] is not None), key=lambda r: (r[0], r[1], r[2])):
        anchor, count = state.get(k, (None, 0))
        if anchor is None or s >= anchor + width:
            anchor, count = s, 0
        state[k] = (anchor, count + 1)
        out.append((k, s, i, anchor, count + 1, count + 1 <= n))
    return sorted(out)


def run(spark, rows, width, n):
    at = [(k, None if s is None else START + timedelta(seconds=s), i, "x") for k, s, i in rows]
    df = spark.createDataFrame(at, "user_id string, ts timestamp, event_id bigint, _key string").repartition(3)
    got = limits.limit_anchored(df, "user_id", n, width).collect()

    def seconds(t):
        return None if t is None else int((t.replace(tzinfo=timezone.utc) - START).total_seconds())

    return [(r.user_id, seconds(r.ts), r.event_id, seconds(r.anchor), r.hit_no, r.allowed) for r in got]


@pytest.mark.parametrize("width, spread", [(600, 40_000), (600, 500), (5, 40_000), (100_000, 40_000)])
def test_hot_key_and_small_keys(spark, width, spread):
    rng = random.Random(width + spread)
    rows = [("hot", rng.randrange(spread), i) for i in range(3000)] + [(f"u{rng.randrange(200)}", rng.randrange(spread), 5000 + i) for i in range(1500)]
    assert sorted(run(spark, rows, width, 3)) == by_hand(rows, width, 3)


def test_burst_in_one_window_is_cut(spark):
    rows = [("hot", i // 50, i) for i in range(4000)] + [("cold", 3, 1)]
    assert sorted(run(spark, rows, 3600, 10)) == by_hand(rows, 3600, 10)
    at = spark.createDataFrame([(k, START + timedelta(seconds=s), i) for k, s, i in rows], "user_id string, ts timestamp, event_id bigint")
    seen = []
    real = limits.materialize
    limits.materialize = lambda df, name: seen.append(real(df, name)) or seen[-1]
    try:
        limits.limit_anchored(at, "user_id").count()
    finally:
        limits.materialize = real
    assert seen[0].filter("_key = 'hot'").select("_seg").distinct().count() > 1


def test_nulls_pass_and_ids_may_repeat(spark):
    rows = [(None, 5, 1), ("a", None, 2), (None, None, 3), ("a", 1, 7), ("b", 1, 7), ("a", 2, 7), ("a", 2, 7), ("a", 2, None)]
    got = run(spark, rows, 60, 2)
    assert sorted((str(r[:3]), r[3:]) for r in got if r[0] is None or r[1] is None) == [
        ("('a', None, 2)", (None, None, True)), ("(None, 5, 1)", (None, None, True)), ("(None, None, 3)", (None, None, True))]
    assert sorted((r[0], r[4], r[5]) for r in got if r[0] and r[1] is not None) == [("a", 1, True), ("a", 2, True), ("a", 3, False), ("a", 4, False), ("b", 1, True)]


def test_no_events(spark):
    assert run(spark, [], 60, 2) == []


class State:
    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


def test_late_hits_of_a_stream_are_allowed_and_flagged():
    window = stream.AnchoredWindow(2, 60, 100)
    window.window = State()

    def batch(*hits):
        frames = [pd.DataFrame({"us": [s * 1_000_000 for s, _ in hits], "event_id": [i for _, i in hits]})]
        out = next(window.handleInputRows((9,), iter(frames), None))
        return [(r.event_id, None if pd.isna(r.anchor_us) else r.anchor_us // 1_000_000, None if pd.isna(r.hit_no) else r.hit_no, r.allowed, r.late) for r in out.itertuples()]

    assert batch((1000, 1), (1010, 2), (1020, 3)) == [(1, 1000, 1, True, False), (2, 1000, 2, True, False), (3, 1000, 3, False, False)]
    assert batch((919, 4), (920, 5), (1030, 6)) == [(4, None, None, True, True), (5, 1000, 4, False, False), (6, 1000, 5, False, False)]
    assert batch((10, 7)) == [(7, None, None, True, True)] and window.window.get() == (1000 * 1_000_000, 5, 1030 * 1_000_000)


def test_stream_gives_every_hit(spark, tmp_path):
    stream.use_rocksdb(spark)
    source, schema = tmp_path / "in", "user_id bigint, ts timestamp, event_id bigint"
    hits = [[(1, 1000, 1), (1, 1001, 2), (None, 5, 3), (2, None, 4)], [(1, 1002, 5), (1, 1, 6), (2, 7, 8)]]
    for i, rows in enumerate(hits):
        spark.createDataFrame([(k, None if s is None else START + timedelta(seconds=s), e) for k, s, e in rows], schema).coalesce(1).write.mode("append").parquet(str(source))
        out = stream.limit_anchored_stream(spark.readStream.schema(schema).parquet(str(source)), "user_id", 2, 60, lateness_seconds=100)
        q = (out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start())
        q.awaitTermination()
    got = {r.event_id: (r.hit_no, r.allowed, r.late) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: (1, True, False), 2: (2, True, False), 3: (None, True, False), 4: (None, True, False), 5: (3, False, False), 6: (None, True, True), 8: (1, True, False)}
