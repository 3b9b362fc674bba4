import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from askloom.operators import evaluation as ev, library as lib, limits, logs, practice
from askloom.sources import corpus, sinks


def test_admission_order_and_limit(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, 1, f"d{i}.md", 10, t0 + dt.timedelta(minutes=i)) for i in range(5)]
    rows += [(10, 1, "late.exe", 10, t0 + dt.timedelta(hours=1)), (11, 2, "C:\\x\\y.PDF", 60 << 20, t0), (12, 2, "noext", 1, t0), (13, 2, "a.markdown", 0, t0),
             (14, 2, "b.markdown", 5, t0), (15, 2, "b.exe", 5, t0)]
    df = spark.createDataFrame(rows, "doc_id bigint, kb_id bigint, file_name string, size_bytes bigint, created_at timestamp")
    got = {r.doc_id: r.reason for r in corpus.judge_uploads(df, max_per_kb=3).collect()}
    assert got == {0: None, 1: None, 2: None, 3: "limit", 4: "limit", 10: "limit", 11: "size", 12: "no_extension", 13: "empty", 14: None, 15: "type"}
    accepted, rejected = corpus.admit_documents(df, max_per_kb=3)
    assert {r.file_type for r in accepted.collect()} == {"md"} and rejected.filter("code = 413").count() == 1
    existing = spark.createDataFrame([(1, 2), (2, 3)], "kb_id bigint, n bigint")
    got = {r.doc_id: r.reason for r in corpus.judge_uploads(df, existing=existing, max_per_kb=3).collect()}
    assert got[0] is None and got[1] == "limit" and got[14] == "limit" and got[11] == "limit" and got[13] == "empty"


def anchored_model(events, n, width):
    out, state = {}, {}
    for k, ts, i in sorted(events, key=lambda e: (e[1], e[2])):
        anchor, count = state.get(k, (None, 0))
        if anchor is None or ts >= anchor + width:
            anchor, count = ts, 0
        state[k] = (anchor, count + 1)
        out[i] = (anchor, count + 1, count + 1 <= n)
    return out


def test_anchored_limit_with_a_hot_key(spark):
    rng = random.Random(4)
    base = 1_700_000_000
    events = [("hot" if i % 3 == 0 else f"k{rng.randint(0, 9)}", base + rng.randint(0, 400_000), i) for i in range(6000)]
    events += [("edge", base, 9000), ("edge", base + 600, 9001), ("edge", base + 599, 9002), ("gap", base, 9003), ("gap", base + 10_000_000, 9004)]
    df = spark.createDataFrame(events, "k string, s bigint, event_id bigint").withColumn("ts", F.timestamp_seconds("s")).repartition(6)
    got = {r.event_id: (r.a, r.hit_no, r.allowed) for r in
           limits.limit_anchored(df, "k", 3, 600).withColumn("a", F.unix_seconds("anchor")).collect()}
    assert got == anchored_model(events, 3, 600)


def test_daily_limit(spark):
    day = dt.datetime(2024, 5, 1)
    rows = [(1, day + dt.timedelta(seconds=i), i) for i in range(5)] + [(1, day + dt.timedelta(days=1), 9)]
    df = spark.createDataFrame(rows, "ip bigint, ts timestamp, event_id bigint")
    assert {r.event_id: r.allowed for r in limits.limit_per_day(df, "ip", 3).collect()} == {0: True, 1: True, 2: True, 3: False, 4: False, 9: True}


def test_hits_and_credit_scope(spark):
    cands = spark.createDataFrame([("c3", "STRUCTURE_AWARE", False, 1, 1, 10, 100, "x"), ("c4", "STRUCTURE_AWARE", True, 1, 2, 11, 200, "x"),
                                   ("c1", "FIXED", False, 1, 3, 99, None, "abcdefghijklmno"), ("c3", "STRUCTURE_AWARE", False, 2, 1, 12, 200, "x")],
                                  "config string, strategy string, parent_credit boolean, q_id bigint, rank int, chunk_id bigint, parent_id bigint, content string")
    golds = spark.createDataFrame([(1, 10, 100, "abc defghijklmno"), (2, 13, 200, "zzz")], "q_id bigint, chunk_id bigint, parent_id bigint, content string")
    assert {(r.config, r.q_id, r["rank"]) for r in ev.hits(cands, golds).collect()} == {("c3", 1, 1), ("c4", 1, 2), ("c1", 1, 3)}
    assert {(r.config, r.q_id, r["rank"]) for r in ev.hits(cands, golds, "question").collect()} == {("c3", 1, 1), ("c1", 1, 3)}


def test_verdicts_and_calibration(spark):
    v = spark.createDataFrame([(1, "a [1] b [1][2]", '{"faithful":true,"citations":[{"no":1,"supports":true},{"no":2,"supports":false}]}'), (2, "c [3]", "oops")],
                              "q_id bigint, answer string, verdict string")
    r = ev.citation_accuracy(v).first()
    assert (r.supported, r.used, r.citation_accuracy) == (1, 4, 0.25)
    q = spark.createDataFrame([(1, 1, "FACT"), (1, 2, "TABLE"), (1, 3, "FACT"), (1, 4, "NO_ANSWER")], "kb_id bigint, q_id bigint, type string")
    assert abs(ev.faithfulness(q, v).first().faithfulness - 1 / 3) < 1e-12
    s = spark.createDataFrame([(1, "FACT", 0.8), (1, "FACT", 0.6), (1, "NO_ANSWER", 0.3), (2, "FACT", 0.9)], "kb_id bigint, type string, top_score double")
    got = {r.kb_id: (r.suggested_threshold, r.min_answerable, r.max_no_answer) for r in ev.calibrate_threshold(s).collect()}
    assert got == {1: (0.45, 0.6, 0.3), 2: (0.35, 0.9, -1.0)}


def test_practice(spark):
    quiz = '{"questions":[{"type":"single","stem":"s1","answer":"A","sourceNos":[1,3,0]},{"stem":"s2","answer":"B"},{"stem":"s3","answer":"C","sourceNos":[2]}]}'
    df = spark.createDataFrame([(1, quiz, [11, 12]), (2, '{"questions":[]}', [1]), (3, "bad", [1])], "quiz_id bigint, quiz string, unit_ids array<bigint>")
    rows = practice.source_no_to_chunk(df).orderBy("pos").collect()
    assert [(r.quiz_id, r.type, r.source_chunk_ids) for r in rows] == [(1, "single", [11]), (1, "short", []), (1, "short", [12])]
    grades = '[{"index":0,"score":50},{"index":1,"score":100}]'
    a = spark.createDataFrame([(1, 1, "v", "2024", '[{"stem":"x"},{"stem":"y"}]', '["p"]', grades)],
                              "attempt_id bigint, kb_id bigint, visitor_id string, created_at string, questions string, answers string, grades string")
    assert practice.attempt_total(a).first().total_score == 75
    assert [(r.stem, r.user_answer) for r in practice.wrong_book(a).collect()] == [("x", "p")]
    marked = practice.mark_mastered(a, spark.createDataFrame([(1, 0), (1, 7)], "attempt_id bigint, question_index int"))
    assert practice.wrong_book(marked).count() == 0 and practice.attempt_summary(marked).first().wrong_count == 0


def test_library(spark):
    units = spark.createDataFrame([(1, i, f"50%_a > {i}") for i in range(9)] + [(2, 100, "50%_a"), (1, 50, "500_a")], "kb_id bigint, unit_id bigint, section_path string")
    got = lib.sample_units(units, 6, "1", "50%_")
    assert got.count() == 6 and {r.kb_id for r in got.collect()} == {1} and got.filter("unit_id = 50").count() == 0
    docs = spark.createDataFrame([(1, "PENDING", None), (2, "READY", None)], "doc_id bigint, status string, error_msg string")
    assert {r.doc_id: r.status for r in lib.recover_interrupted(docs).collect()} == {1: "FAILED", 2: "READY"}
    msgs = spark.createDataFrame([(1, 0, "user"), (1, 1, "assistant"), (1, 2, "user"), (2, 0, "assistant")], "conv_id bigint, turn bigint, role string")
    assert {(r.conv_id, r.turn): r.first_question for r in logs.first_question_flag(msgs).collect()} == {(1, 0): True, (1, 1): True, (1, 2): False, (2, 0): True}


def test_write_chunks_replaces_per_document_and_strategy(spark, tmp_path):
    cols = "doc_id bigint, strategy string, chunk_index int, content string"
    path = str(tmp_path / "chunks")
    sinks.write_chunks(spark.createDataFrame([(1, "FIXED", 0, "a"), (1, "FIXED", 1, "b"), (2, "FIXED", 0, "c"), (1, "RECURSIVE", 0, "r")], cols), path)
    again = spark.createDataFrame([(1, "FIXED", 0, "new")], cols)
    for _ in range(2):
        sinks.write_chunks(again, path)
    got = {(r.doc_id, r.strategy, r.chunk_index, r.content) for r in sinks.read_chunks(spark, path).collect()}
    assert got == {(1, "FIXED", 0, "new"), (2, "FIXED", 0, "c"), (1, "RECURSIVE", 0, "r")}


def test_failing_log_does_not_raise(spark):
    assert "nosuchscheme" in sinks.append_query_log(spark.range(1), "nosuchscheme://x/y")


def test_text_file_scan(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.MD").write_text("# t\n\nx", encoding="utf-8")
    r = corpus.scan_text_files(spark, str(tmp_path)).first()
    assert (r.file_name, r.file_type, r.text) == ("a.MD", "md", "# t\n\nx")


def test_ingest_stream_is_idempotent(spark, tmp_path):
    from askloom.streaming import ingest
    src, out = tmp_path / "in", tmp_path / "out"
    spark.createDataFrame([(1, "# A\n\nbody"), (2, " ")], "doc_id bigint, text string").coalesce(1).write.parquet(str(src))
    schema = spark.read.parquet(str(src)).schema

    def run(checkpoint):
        ingest.ingest_stream(ingest.document_stream(spark, str(src), schema), f"{out}/store", f"{out}/{checkpoint}").awaitTermination()
        store = ingest.ingest_store(spark, f"{out}/store")
        return store.read("chunks").count(), {r.doc_id: r.status for r in store.read("status").collect()}

    first = run("cp1")
    assert first == (2, {1: "READY", 2: "FAILED"}) and run("cp2") == first


@pytest.mark.parametrize("limit", ["10485760b", "-1"])
def test_shingle_coverage(spark, limit):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        left = spark.createDataFrame([(1, "abcdefghijklmnop"), (2, "short")], "item bigint, text string")
        right = spark.createDataFrame([(7, "zz abcdefghijklmnop zz"), (8, "nothing in common here at all")], "doc bigint, text string")
        got = ev.shingle_coverage(left, right, "item", "doc").collect()
        assert [(r.item, r.doc, r.shared, r.coverage) for r in got] == [(1, 7, 7, 1.0)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
