"""Rules that small or regular inputs hide: gaps between turns, several strategies, late versions, files over the limit."""

import time

import pytest
from pyspark.sql import functions as F

from askloom.functions.ranking import bytes_of
from askloom.operators import reading, retrieval
from askloom.sources import corpus
from askloom.streaming import ingest


def test_history_counts_messages_over_gaps(spark):
    rows = [(1, t * 10, "user", f"m{t}") for t in range(9)] + [(2, 5, "user", "only")]
    got = {(r.conv_id, r.turn): [h.content for h in r.history] for r in retrieval.history_window(
        spark.createDataFrame(rows, "conv_id long, turn long, role string, content string")).collect()}
    assert got[2, 5] == [] and got[1, 0] == [] and got[1, 30] == ["m0", "m1", "m2"] and got[1, 80] == [f"m{i}" for i in range(2, 8)]


def test_cards_of_two_strategies(spark):
    rows = [(1, 1, s, 0, None, f"parent {s}") for s in "ab"] + [(10 + i, 1, "a", i, 1, f"a{i}") for i in (1, 2)] + [(20 + i, 1, "b", i, 1, f"b{i}") for i in (1, 2)]
    rows = [(cid + (100 if s == "b" and cid == 1 else 0), d, s, i, p, c) for cid, d, s, i, p, c in rows]
    chunks = spark.createDataFrame(rows, "chunk_id long, doc_id long, strategy string, chunk_index int, parent_id long, content string").withColumn(
        "section_path", F.lit("s")).withColumn("page_no", F.lit(1))
    docs = spark.createDataFrame([(1, 9, "f.md")], "doc_id long, kb_id long, file_name string")
    cards = {r.chunk_id: (r.prev_content, r.next_content) for r in reading.chunk_context(chunks, docs).collect()}
    assert cards == {1: (None, "a1"), 101: (None, "b1"), 11: (None, "a2"), 12: ("a1", None), 21: (None, "b2"), 22: ("b1", None)}


def test_file_over_the_limit_is_a_row(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(corpus, "MAX_BYTES", 10)
    (tmp_path / "small.md").write_text("tiny")
    (tmp_path / "large.md").write_text("x" * 11)
    got = {r.file_name: (r.reason, r.text, r.size_bytes) for r in corpus.scan_text_files(spark, str(tmp_path)).collect()}
    assert got == {"small.md": (None, "tiny", 4), "large.md": ("size", None, 11)}


@pytest.mark.parametrize("together", [True, False])
def test_shortened_version_wins(spark, tmp_path, together):
    schema = "doc_id long, text string"
    source, out = tmp_path / "in", tmp_path / "out"

    def write(text, name):
        spark.createDataFrame([(1, text)], schema).coalesce(1).write.parquet(f"{tmp_path}/{name}")
        part = next((tmp_path / name).glob("*.parquet"))
        source.mkdir(exist_ok=True)
        (source / f"{name}.parquet").write_bytes(part.read_bytes())

    def run():
        stream = ingest.document_stream(spark, str(source), spark.createDataFrame([], schema).schema)
        ingest.ingest_stream(stream, f"{out}/store", f"{out}/checkpoint").awaitTermination()

    write("# A\n\na much longer first version of the document", "first")
    if not together:
        run()
    time.sleep(1.1)
    write("# A\n\nshort", "second")
    run()
    rows = ingest.ingest_store(spark, f"{out}/store").read("chunks").collect()
    assert rows and all("longer" not in r.content for r in rows)


@pytest.mark.parametrize("text, want", [("10485760", 10485760), ("256k", 262144), ("100MB", 104857600), ("10485760b", 10485760), ("-1", -1), ("1g", 1 << 30)])
def test_size_settings(text, want):
    assert bytes_of(text) == want
