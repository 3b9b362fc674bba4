"""Texts counted in one pass, terms and shingles hashed in batches."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from askloom.functions import text as tx
from askloom.operators import chunking, evaluation as ev, indexing

PARTS = ["ab", "Zoë", "7", "漢", "字", "😀", "́", " ", "  ", "\n", "\t", "\x00", "\x7f", "\x85", " ", "　", "-", "!!", "ж", "²", "\U00020000"]


def test_tokens_are_counted_in_one_pass(spark):
    rng = random.Random(5)
    texts = [None, "", " ", "\n", "a\nb", "a \x01 b", "ab\x01", *("".join(rng.choice(PARTS) for _ in range(rng.randint(1, 30))) for _ in range(300))]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    clean = F.regexp_replace("t", tx.CONTROL_CHARS, "")
    two = F.when(F.col("t").isNull() | (F.length("t") == 0), 0).otherwise(F.length(F.replace(F.regexp_replace(clean, tx.WORD, "a"), F.lit(" "), F.lit(""))) + 2)
    assert df.filter(tx.count_tokens(F.col("t")) != two).collect() == []
    # the text is rewritten once
    plan = df.select(tx.count_tokens(F.col("t")).alias("n"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == 1


def test_structure_chunks_count_an_element_once(spark, elements):
    df = elements(("HEADING", "One", 1, 1), ("PARAGRAPH", "a b c", 0, 1), ("PARAGRAPH", " ", 0, 1))
    body = df.select(F.explode(chunking.parents_of(F.col("elements"))).alias("p")).first().p.body
    assert [e.tokens for e in body] == [5, 2]
    assert [r.content for r in chunking.structure_chunks(df).collect()] == ["a b c", "a b c"]


def test_each_different_term_gets_its_slot():
    terms = pa.array(["a", "漢", "a", "", "zz", "漢"])
    expected = [int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % 512 for t in terms.to_pylist()]
    assert indexing._term_slots(terms, 512).tolist() == expected
    assert indexing._term_slots(pa.array([], pa.string()), 512).tolist() == []


def test_vectors_of_several_batches(spark, monkeypatch):
    texts = ["b a b", "", None, "漢字 a", "!!", "a a a c"] * 3
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string").coalesce(1)
    whole = {r.id: r.vector for r in indexing.hashed_embedder()(df, "t").collect()}
    monkeypatch.setattr(indexing, "TERM_ROWS", 2)
    assert {r.id: r.vector for r in indexing.hashed_embedder()(df, "t").collect()} == whole
    assert np.count_nonzero(whole[0]) == 2 and not any(whole[1])


def test_shingles_are_hashed_side_by_side(spark, monkeypatch):
    monkeypatch.setattr(ev, "GRAMS_AT_ONCE", 40)
    rng = random.Random(6)
    texts = [None, "", "short", "exactly10!", *("".join(rng.choice("ab 😀漢\n") for _ in range(rng.randint(0, 60))) for _ in range(60))]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, t string")
    rows = ev._hashed_grams(df, "id", "t", "n", tx.SHINGLE).collect()
    assert len(rows) == len(texts)
    for r in rows:
        flat = re.sub(r"[ \t\n\x0b\f\r]+", "", texts[r.id] or "")
        assert r.n == len(r.grams) == len(set(r.grams)) == len({flat[i:i + 10] for i in range(len(flat) - 9)})
        assert sorted(g % 2**64 for g in r.grams) == ev._gram_hashes(flat).tolist()
