"""The merge-on-read store and the ingest that writes it."""

import pytest
from pyspark.sql import functions as F

from askloom.operators import indexing, retrieval
from askloom.sources import sinks
from askloom.sources.versioned import VersionedStore
from askloom.streaming import ingest

ROWS = "k bigint, s string, v string"


def make(spark, path):
    return VersionedStore(spark, str(path), {"a": ("k", "s"), "b": ("k",)}, {"a": ("s",)})


def put(store, rows, batch=None, replaced=None, table="a"):
    commit = store.begin(batch)
    if commit is None:
        return False
    with commit:
        spark = store.spark
        commit.write(table, spark.createDataFrame(rows, ROWS), None if replaced is None else spark.createDataFrame(replaced, "k bigint, s string"))
    return True


def seen(store, table="a"):
    return sorted((r.k, r.s, r.v) for r in store.read(table).collect())


def test_newest_rows_of_a_key_win(spark, tmp_path):
    store = make(spark, tmp_path / "s")
    put(store, [(1, "x", "a"), (1, "x", "b"), (2, "x", "c"), (1, "y", "d")])
    put(store, [(1, "x", "new")])
    put(store, [], replaced=[(2, "x")])
    assert seen(store) == [(1, "x", "new"), (1, "y", "d")]
    put(store, [(2, "x", "back")])
    assert seen(store) == [(1, "x", "new"), (1, "y", "d"), (2, "x", "back")]


def test_untouched_files_stay(spark, tmp_path):
    store = make(spark, tmp_path / "s")
    put(store, [(i, "x", "old") for i in range(20)])

    def files():
        return {str(f): f.stat().st_mtime_ns for f in (tmp_path / "s" / "a").rglob("*.parquet")}

    before = files()
    put(store, [(3, "x", "new")])
    after = files()
    assert before.items() <= after.items() and len(after) > len(before)
    assert len(seen(store)) == 20 and (3, "x", "new") in seen(store)


def test_failed_write_is_never_seen(spark, tmp_path):
    store = make(spark, tmp_path / "s")
    with pytest.raises(ValueError, match="no commit"):
        store.read("a")
    put(store, [(1, "x", "old")])
    with pytest.raises(RuntimeError, match="lost"), store.begin("b1") as commit:
        commit.write("a", spark.createDataFrame([(1, "x", "half")], ROWS))
        raise RuntimeError("lost")
    assert seen(store) == [(1, "x", "old")] and len(store.log()) == 1
    assert put(store, [(1, "x", "whole")], "b1") and seen(store) == [(1, "x", "whole")]
    assert len(store.expire()) == 2 and seen(store) == [(1, "x", "whole")]


def test_batch_is_written_once(spark, tmp_path):
    store = make(spark, tmp_path / "s")
    assert put(store, [(1, "x", "a")], "b1") and not put(store, [(1, "x", "other")], "b1")
    store.compact()
    put(store, [(2, "x", "b")], "b2")
    store.compact()
    assert not put(store, [(1, "x", "other")], "b1") and seen(store) == [(1, "x", "a"), (2, "x", "b")]


def test_tables_of_one_commit_appear_together(spark, tmp_path):
    store = make(spark, tmp_path / "s")
    with store.begin() as commit:
        first = commit.write("a", spark.createDataFrame([(1, "x", "a")], ROWS))
        commit.write("b", first.withColumn("v", F.lit("b")))
        staged = commit.stage("t", first)
        assert staged.count() == 1 and not store.log()
    assert seen(store) == [(1, "x", "a")] and seen(store, "b") == [(1, "x", "b")]
    assert not list((tmp_path / "s" / "_staged").rglob("*.parquet"))


def test_compaction_changes_no_row(spark, tmp_path):
    store = make(spark, tmp_path / "s")
    for i in range(6):
        put(store, [(k, "xy"[k % 2], f"{i}") for k in range(i, 9)])
    want = seen(store)
    assert [r[2] for r in want] == ["0", "1", "2", "3", "4"] + ["5"] * 4 or len(want) == 9
    store.compact()
    assert seen(store) == want and len(store.live()) == 1
    store.compact()
    assert len(store.log()) == 7
    assert store.expire() and seen(store) == want
    put(store, [(0, "x", "later")])
    assert seen(store)[0] == (0, "x", "later")
    plan = store.read("a").filter("s = 'x'")._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan


def test_nulls_and_empty_commits(spark, tmp_path):
    store = make(spark, tmp_path / "s")
    put(store, [])
    assert seen(store) == []
    put(store, [(None, "x", "a"), (1, "x", None)])
    put(store, [(None, "x", "b"), (1, "x", "c")])
    assert sorted((r.k, r.v) for r in store.read("a").collect() if r.k is None) == [(None, "a"), (None, "b")]
    assert [(r.k, r.v) for r in store.read("a").collect() if r.k == 1] == [(1, "c")]


def test_chunk_batches(spark, tmp_path):
    rows = spark.createDataFrame([(1, "FIXED", 0, "a")], "doc_id bigint, strategy string, chunk_index int, content string")
    path = str(tmp_path / "c")
    assert sinks.write_chunks(rows, path, "b") and not sinks.write_chunks(rows.withColumn("content", F.lit("z")), path, "b")
    assert sinks.read_chunks(spark, path).first().content == "a"


# ---- ingest ----

DOC = "doc_id bigint, text string, arrived bigint"


def documents(spark, rows):
    return spark.createDataFrame(rows, DOC)


def test_ingest_batch_writes_every_table(spark, tmp_path):
    store = ingest.ingest_store(spark, str(tmp_path / "s"))
    docs = [(1, "# Bees\n\nHoney bees dance. Bees fly.", 1), (2, " \n ", 1), (3, None, 1), (4, "# Only a heading", 1), (1, "old", 0)]
    assert ingest.ingest_batch(documents(spark, docs), store, "b0")
    status = {r.doc_id: r for r in store.read("status").collect()}
    assert {d: (r.status, r.error_msg) for d, r in status.items()} == {
        1: ("READY", None), 2: ("FAILED", ingest.NO_TEXT), 3: ("FAILED", ingest.NO_TEXT), 4: ("FAILED", ingest.NO_CHUNK)}
    chunks = store.read("chunks").filter("kind = 'child'").collect()
    assert status[1].token_count == sum(r.token_count for r in chunks) > 0 and status[1].chunk_count == len(chunks) and status[1].page_count == 1
    assert {r.chunk_id for r in store.read("vectors").collect()} == {r.chunk_id for r in chunks}
    terms = {(r.term, r.tf): r.positions for r in store.read("postings").collect()}
    assert terms["bees", 2] and ("old", 1) not in terms


def test_ingest_replays_and_replaces(spark, tmp_path):
    store = ingest.ingest_store(spark, str(tmp_path / "s"))
    ingest.ingest_batch(documents(spark, [(1, "# A\n\nalpha text", 1), (2, "# B\n\nbeta text", 1)]), store, "b0")
    log = len(store.log())
    assert not ingest.ingest_batch(documents(spark, [(1, "# A\n\nsomething else", 1)]), store, "b0") and len(store.log()) == log
    ingest.ingest_batch(documents(spark, [(1, "# A\n\ngamma text", 2), (2, "", 2)]), store, "b1")
    assert {r.term for r in store.read("postings").filter("doc_id = 1").collect()} == {"gamma", "text"}
    kb = spark.createDataFrame([(1, 7), (2, 7)], "doc_id bigint, kb_id bigint")
    vectors, postings = ingest.recall_tables(store, kb)
    asked = spark.createDataFrame([(9, 7, "gamma text"), (10, 7, "beta")], "q_id bigint, kb_id bigint, question string")
    found = retrieval.keyword_topk(retrieval.query_terms(asked), postings).collect()
    assert [(r.q_id, r.rank) for r in found] == [(9, 1)], "the failed version hides document 2"
    near = retrieval.vector_topk(indexing.hashed_embedder()(asked, "question"), vectors).filter("q_id = 9").collect()
    assert len(near) == 1 and near[0].score > 0.9
    assert store.read("chunks").filter("doc_id = 2").count() > 0, "the last good version is kept"


def test_ingest_stream_replay_of_a_lost_batch(spark, tmp_path):
    """A stream whose last batch was committed to the store but not to its checkpoint writes it again and changes nothing."""
    source, out = tmp_path / "in", tmp_path / "out"
    documents(spark, [(1, "# A\n\nalpha", 1)]).drop("arrived").coalesce(1).write.parquet(str(source))
    schema = spark.read.parquet(str(source)).schema
    store = ingest.ingest_store(spark, f"{out}/store")

    def run():
        ingest.ingest_stream(ingest.document_stream(spark, str(source), schema), f"{out}/store", f"{out}/checkpoint").awaitTermination()

    run()
    commits = out / "checkpoint" / "commits"
    for f in [*commits.glob("0"), *commits.glob(".0.crc")]:
        f.unlink()
    run()
    assert len(store.log()) == 1 and store.read("chunks").count() == 2
