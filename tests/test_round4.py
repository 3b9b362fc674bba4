"""Golds in tiles against brute force, terms counted in batches, the grid's hits worked out once."""

import random
import re

from askloom.functions.text import SHINGLE
from askloom.operators import evaluation as ev, indexing

SMALL = "/root/testdata/sf0.001"


def grams(text):
    flat = re.sub(r"[ \t\n\x0b\f\r]+", "", text or "")
    return {flat[i:i + SHINGLE] for i in range(len(flat) - SHINGLE + 1)}


def test_golds_meet_candidates_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(ev, "GOLD_TILE", 2)
    monkeypatch.setattr(ev, "CANDIDATE_GROUP", 2)
    rng = random.Random(4)
    words = ["alpha", "beta 😀", "gamma\n", "delta", "漢字", "omega"]
    text = {i: " ".join(rng.choice(words) for _ in range(rng.randint(0, 9))) for i in range(40)} | {40: None, 41: ""}
    cands = [("c1", "FIXED", False, q, r + 1, rng.randint(0, 41)) for q in (1, 2, 3) for r in range(7)]
    golds = [(q, g) for q in (1, 2, None) for g in rng.sample(range(42), 9)] + [(1, None), (3, 40)]
    cand_rows = spark.createDataFrame([(*c, None, text[c[5]]) for c in cands * 2], "config string, strategy string, parent_credit boolean, q_id bigint, rank int, chunk_id bigint, parent_id bigint, content string")
    gold_rows = spark.createDataFrame([(q, g, None, text.get(g)) for q, g in golds * 2], "q_id bigint, chunk_id bigint, parent_id bigint, content string")

    def alike(a, b):
        a, b = grams(text[a]), grams(text[b])
        return bool(a and b) and len(a & b) / min(len(a), len(b)) >= ev.MIN_COVERAGE

    expected = {(c[0], c[3], c[4]) for c in cands if any(q == c[3] and g is not None and (g == c[5] or alike(c[5], g)) for q, g in golds)}
    got = [(r.config, r.q_id, r["rank"]) for r in ev.hits(cand_rows, gold_rows).collect()]
    assert len(got) == len(set(got)) and set(got) == expected
    assert 0 < len(expected) < len({c[:5] for c in cands})


def test_gold_tiles_hold_a_share_of_a_questions_golds(spark, monkeypatch):
    met = []
    monkeypatch.setattr(ev, "salted_join", lambda tiles, *a, join=ev.salted_join: (met.append(tiles.selectExpr("max(size(golds)) AS n", "sum(size(golds)) AS total").first()), join(tiles, *a))[1])
    cand = spark.createDataFrame([("c1", "FIXED", False, 1, 1, 5, None, "abcdefghijklmno")], "config string, strategy string, parent_credit boolean, q_id bigint, rank int, chunk_id bigint, parent_id bigint, content string")
    golds = spark.range(1000).selectExpr("1L AS q_id", "id + 10 AS chunk_id", "CAST(NULL AS BIGINT) AS parent_id", "CASE id WHEN 7 THEN 'abcdefghijklmno' ELSE 'zzzzzzzzzzzzzzz' || id END AS content")
    assert [tuple(r) for r in ev.hits(cand, golds).collect()] == [("c1", 1, 1)]
    assert met[0].total == 1000 and met[0].n < 4 * ev.GOLD_TILE


def test_grid_works_out_its_hits_once(spark):
    import askloom.plans.catalog  # noqa: F401
    from askloom.plans import evaluation_queries as q

    g = q.grid(spark, SMALL)
    assert g.hits is g.hits and all("/askloom/" in f for f in g.hits.inputFiles())


def test_postings_of_several_batches(spark, monkeypatch):
    monkeypatch.setattr(indexing, "TERM_ROWS", 2)
    texts = ["b a b", "", None, "漢字 a", "!!", "a a a c"]
    df = spark.createDataFrame([(1, f"k{i}", t) for i, t in enumerate(texts)], "kb_id int, id string, content string").coalesce(1)
    got = {(r.kb_id, r.id, r.term): (r.tf, r.positions) for r in indexing.build_postings(df, "kb_id", "id").collect()}
    assert got == {(1, "k0", "a"): (1, [2]), (1, "k0", "b"): (2, [1, 3]), (1, "k3", "漢"): (1, [1]), (1, "k3", "字"): (1, [2]), (1, "k3", "漢字"): (1, [3]),
                   (1, "k3", "a"): (1, [4]), (1, "k5", "a"): (3, [1, 2, 3]), (1, "k5", "c"): (1, [4])}
    counts = indexing.term_counts(df, "kb_id", "id")
    assert {(r.kb_id, r.id, r.term): r.tf for r in counts.collect()} == {k: v[0] for k, v in got.items()}


def test_blocks_are_packed_without_writing_the_postings(spark, tmp_path, monkeypatch):
    import askloom.plans.catalog  # noqa: F401
    from askloom.plans import tables as t

    names = []
    monkeypatch.setattr(t, "_WRITTEN", {})
    monkeypatch.setattr(t, "materialize", lambda df, name, write=t.materialize: (names.append(name), write(df, name))[1])
    blocks = t.term_blocks(spark, SMALL)
    assert not any(n.startswith("postings") for n in names)
    listed = blocks.selectExpr("term", "explode(arrays_zip(ids, values)) AS e").selectExpr("term", "e.ids AS chunk_id", "CAST(e.values AS BIGINT) AS tf")
    counted = t.postings(spark, SMALL).select("term", "chunk_id", "tf")
    assert listed.count() == counted.count() and not listed.exceptAll(counted).count()
