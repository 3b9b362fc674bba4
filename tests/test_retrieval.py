import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from askloom.functions import ranking
from askloom.operators import indexing, reading, recall, retrieval as rt


def ranked(spark, rows):
    return spark.createDataFrame(rows, "q_id bigint, chunk_id bigint, score double, rank int")


def test_rrf(spark):
    vec = ranked(spark, [(1, c, 1.0 - r / 10, r) for r, c in enumerate([1, 2, 3], 1)])
    kw = ranked(spark, [(1, c, 5.0 - r, r) for r, c in enumerate([2, 4], 1)])
    rows = rt.rrf_fuse(vec, kw).orderBy("rrf_rank").collect()
    assert rows[0].chunk_id == 2 and abs(rows[0].rrf_score - (1 / 62 + 1 / 61)) < 1e-12
    assert len(rows) == 4 and rt.rrf_fuse(vec, kw, limit=2).count() == 2
    assert (rows[0].vector_rank, rows[0].fts_rank) == (2, 1)


def brute_topk(questions, chunks, k):
    out = set()
    for q, kb, v in questions:
        scored = []
        for ckb, c, w in chunks:
            if ckb == kb:
                s = float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w))
                scored.append((-round(s, 6), c))
        out |= {(q, c, i + 1) for i, (_, c) in enumerate(sorted(scored)[:k])}
    return out


@pytest.mark.parametrize("limit", ["10485760b", "-1"])
@pytest.mark.parametrize("state", [64 << 20, 0])
def test_vector_topk_of_small_tiles_equals_brute_force(spark, monkeypatch, limit, state):
    rng = np.random.default_rng(1)
    chunks = [(1 if i % 3 else 2, i, [float(x) for x in rng.integers(-2, 3, size=4)] if i % 5 else [1.0, 0.0, 0.0, 0.0]) for i in range(400)]
    chunks = [(kb, c, v if any(v) else [1.0] * 4) for kb, c, v in chunks]
    questions = [(q, 1 + q % 2, [float(x) for x in rng.normal(size=4)]) for q in range(25)]
    c = spark.createDataFrame([*chunks, (1, 999, None), (1, 998, []), (None, 997, [1.0] * 4)], "kb_id bigint, chunk_id bigint, vector array<double>").repartition(5)
    q = spark.createDataFrame([*questions, (77, 3, [1.0] * 4), (78, None, [1.0] * 4)], "q_id bigint, kb_id bigint, vector array<double>")
    for name, value in (("TILE_QUESTIONS", 4), ("BLOCK_BYTES", 640), ("STATE_BYTES", state), ("SHARES", 3)):
        monkeypatch.setattr(recall, name, value)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        got = {(r.q_id, r.chunk_id, r["rank"]) for r in rt.vector_topk(q, c, 7).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert got == brute_topk(questions, chunks, 7)


def test_vector_topk_reads_the_vectors_without_a_shuffle(spark, tmp_path):
    spark.createDataFrame([(1, i, [1.0, float(i)]) for i in range(50)], "kb_id bigint, chunk_id bigint, vector array<double>").write.parquet(str(tmp_path / "v"))
    spark.createDataFrame([(1, 1, [1.0, 2.0])], "q_id bigint, kb_id bigint, vector array<double>").write.parquet(str(tmp_path / "q"))
    plan = rt.vector_topk(spark.read.parquet(str(tmp_path / "q")), spark.read.parquet(str(tmp_path / "v")), 3)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and plan.count("Exchange hashpartitioning") == 2, "only the best rows are shuffled"


def keyword_by_hand(asked, postings, k, scale, value=lambda q, c, t, tf: tf):
    out = {}
    for q, kb, words in asked:
        sums = {}
        for pkb, c, t, tf in postings:
            if pkb == kb and t in words:
                sums[c] = sums.get(c, 0) + value(kb, c, t, tf)
        out |= {(q, c, i + 1): round(-s * scale, 6) for i, (s, c) in enumerate(sorted((-round(s * scale, 6) / scale, c) for c, s in sums.items())[:k])}
    return out


@pytest.mark.parametrize("limit", ["10485760b", "-1"])
@pytest.mark.parametrize("state", [64 << 20, 0])
def test_keyword_recalls_of_small_blocks(spark, monkeypatch, limit, state):
    rng = random.Random(4)
    vocabulary = ["the"] * 8 + [f"w{i}" for i in range(40)]
    postings = {}
    for c in range(300):
        for w in rng.choices(vocabulary, k=12):
            key = (1 if c % 4 else 2, c, w)
            postings[key] = postings.get(key, 0) + rng.randrange(1, 4)
    postings = [(*key, tf) for key, tf in postings.items()]
    rng.shuffle(postings)
    asked = [(q, 1 + q % 2, set(rng.choices(vocabulary, k=5))) for q in range(21)] + [(90, 1, {"unknown"}), (91, 5, {"the"})]
    p = spark.createDataFrame(postings, "kb_id bigint, chunk_id bigint, term string, tf bigint").repartition(3)
    t = spark.createDataFrame([(q, kb, w) for q, kb, words in asked for w in words], "q_id bigint, kb_id bigint, term string")
    for name, value in (("TILE_QUESTIONS", 4), ("BLOCK_CHUNKS", 7), ("STATE_BYTES", state)):
        monkeypatch.setattr(recall, name, value)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        index = recall.block_index(p)
        assert index.agg(F.max(F.size("ids")), F.max(F.col("bound") - F.array_max("values"))).first()[:] == (7, 0.0)
        want = keyword_by_hand(asked, postings, 9, 0.1)
        for source in (p, index):
            got = {(r.q_id, r.chunk_id, r["rank"]): r.score for r in rt.keyword_topk(t, source, 9).collect()}
            assert set(got) == set(want) and all(abs(got[x] - s) < 1e-6 for x, s in want.items())
        lens, df, kbs = {}, {}, {}
        for kb, c, w, tf in postings:
            lens[c] = lens.get(c, 0) + tf
            df[kb, w] = df.get((kb, w), 0) + 1
            kbs.setdefault(kb, set()).add(c)
        avg = {kb: sum(lens[c] for c in cs) / len(cs) for kb, cs in kbs.items()}

        def bm25(kb, c, w, tf):
            idf = math.log1p((len(kbs[kb]) - df[kb, w] + 0.5) / (df[kb, w] + 0.5))
            return idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * lens[c] / avg[kb]))

        want = keyword_by_hand(asked, postings, 9, 1.0, bm25)
        got = {(r.q_id, r.chunk_id, r["rank"]): r.score for r in rt.bm25_topk(t, p, 9).collect()}
        assert set(got) == set(want) and all(abs(got[x] - s) < 2e-6 for x, s in want.items())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_blocks_that_cannot_reach_the_best_are_skipped(monkeypatch):
    best, q_ids = recall.Best(2), np.array([5, 6])
    best.add(("kb",), q_ids, np.array([1, 2]), np.array([[3.0, 4.0], [-np.inf, 1.0]]))
    added = []
    monkeypatch.setattr(best, "add", lambda *a: added.append(a))
    tile = (pa.array([0, 1], pa.int32()), pa.array(["a", "b"]), pa.array([1.0, 1.0]))

    def score(bound):
        recall._score_block(best, ("kb",), q_ids, *tile, np.array([9]), np.array([0, 0]), np.array([bound, bound]), np.array([0, 1, 2]), {"a": 0, "z": 1}, np.array([bound, bound]), 1.0)

    score(2.0)
    assert not added, "question 5 has two better chunks, question 6 does not ask for these terms"
    score(3.5)
    assert added and added[0][3].tolist() == [[3.5], [-np.inf]]


def test_keyword_topk_salted_equals_broadcast(spark):
    rng = random.Random(2)
    texts = [(1, i, "child", " ".join(rng.choice(["the"] * 6 + ["tree", "graph", "list", "hash", "sort"]) for _ in range(30))) for i in range(200)]
    chunks = spark.createDataFrame(texts, "kb_id bigint, chunk_id bigint, kind string, content string")
    asked = spark.createDataFrame([(1, 1, "The tree, the graph?"), (2, 1, "sort"), (3, 1, "?!")], "q_id bigint, kb_id bigint, question string")
    terms = rt.query_terms(asked)
    assert {(r.q_id, r.term) for r in terms.collect()} == {(1, "the"), (1, "tree"), (1, "graph"), (2, "sort")}
    want = {}
    for q, words in ((1, {"the", "tree", "graph"}), (2, {"sort"})):
        scored = sorted((-round(0.1 * sum(w in words for w in t.split()), 6), c) for _, c, _, t in texts if words & set(t.split()))
        want[q] = [c for _, c in scored[:10]]
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for limit in (old, "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        try:
            for postings in (indexing.term_counts(chunks, "kb_id", "chunk_id"), indexing.asked_term_counts(chunks, terms, "kb_id", "chunk_id")):
                got = {}
                for r in rt.keyword_topk(terms, postings, 10).orderBy("q_id", "rank").collect():
                    got.setdefault(r.q_id, []).append(r.chunk_id)
                assert got == want
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_top_n_cuts_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("k"), "id")
    plan = ranking.top_n(df, ["k"], [F.desc("id")], 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_rerank_and_fallback(spark):
    scored = spark.createDataFrame([(1, 10, 1, 0.2), (1, 11, 2, 0.9), (2, 20, 1, None), (2, 21, 2, 0.9)], "q_id bigint, chunk_id bigint, rrf_rank int, rerank_score double")
    got = [(r.q_id, r.chunk_id, r.rerank_score) for r in rt.rerank(scored).orderBy("q_id", "rank").collect()]
    assert got == [(1, 11, 0.9), (1, 10, 0.2), (2, 20, None), (2, 21, None)]


def test_model_hooks(spark):
    def load():
        return lambda q, p: np.array([1e9 if "boom" in x else len(x) for x in p]) if not any("boom" in x for x in p) else 1 / 0
    df = spark.createDataFrame([("q", "abc"), ("q", "boom")], "q string, p string").coalesce(1)
    scorer = rt.model_scorer(load, batch=1)
    got = [r[0] for r in df.select(scorer(F.col("q"), F.col("p"))).collect()]
    assert abs(got[0] - 1 / (1 + np.exp(-3))) < 1e-12 and got[1] is None
    embedder = indexing.model_embedder(lambda: lambda texts: np.array([[3.0, 4.0]] * len(texts)))
    v = embedder(df, "p").select("vector").first().vector
    assert [round(x, 4) for x in v] == [0.6, 0.8]


def test_hashed_vectors(spark):
    df = spark.createDataFrame([(1, "child", "quick sort of a list"), (2, "child", "quick sort of the list"), (3, "child", "binary tree"), (4, "parent", "x")],
                               "id bigint, kind string, content string")
    v = {r.id: np.array(r.vector) for r in indexing.embed(df, indexing.hashed_embedder()).collect()}
    assert set(v) == {1, 2, 3} and all(len(x) == 512 and abs(np.linalg.norm(x) - 1) < 0.01 for x in v.values())
    assert v[1] @ v[2] > v[1] @ v[3]


def test_refusal_rules(spark):
    q = spark.createDataFrame([(1,), (2,), (3,), (4,)], "q_id bigint")
    top = spark.createDataFrame([(1, 1, 0.34), (2, 1, 0.35), (3, 1, None)], "q_id bigint, rank int, rerank_score double")
    assert {r.q_id: r.refused for r in rt.refuse(q, top).collect()} == {1: True, 2: False, 3: False, 4: True}
    assert {r.q_id: r.refused for r in rt.refuse(q, top, null_refuses=True).collect()} == {1: True, 2: False, 3: True, 4: True}


def test_context_skips_what_overflows_and_goes_on(spark):
    rng = random.Random(9)
    reranked, chunks, parents, want = [], {}, {}, {}
    for q in range(40):
        groups = {}
        for rank in range(1, 9):
            cid = q * 100 + rank
            pid = rng.choice([None, q * 1000 + rng.randint(5000, 5004)])
            chunks[cid] = (cid, pid, rng.randint(10, 400))
            if pid and rng.random() < 0.8:
                parents.setdefault(pid, (pid, rng.randint(300, 1600)))
            reranked.append((q, cid, rank))
            groups.setdefault(pid if pid else -cid, cid)
        want[q] = groups
    expect = {}
    for q, groups in want.items():
        used, out = 0, []
        for key, cid in groups.items():
            unit, n = (key, parents[key][1]) if key in parents else (cid, chunks[cid][2])
            if len(out) < 4 and used + n <= 3000:
                out.append(unit)
                used += n
        expect[q] = out
    got = {}
    df = rt.assemble_context(spark.createDataFrame(reranked, "q_id bigint, chunk_id bigint, rank int"),
                             spark.createDataFrame(list(chunks.values()), "chunk_id bigint, parent_id bigint, token_count int"),
                             spark.createDataFrame(list(parents.values()), "parent_id bigint, parent_tokens int"))
    for r in df.orderBy("q_id", "block_no").collect():
        got.setdefault(r.q_id, []).append(r.unit_id)
    assert got == expect


def test_prompt(spark):
    q = spark.createDataFrame([(1, "什么是栈？")], "q_id bigint, question string")
    ctx = spark.createDataFrame([(1, 1, 7)], "q_id bigint, block_no int, unit_id bigint")
    units = spark.createDataFrame([(7, "ds.pdf", "第3章 栈", 28, "栈是后进先出的线性表。")], "unit_id bigint, file_name string, section_path string, page_no int, content string")
    hist = spark.createDataFrame([(1, [("user", "你好"), ("assistant", "x" * 300)])], "q_id bigint, history array<struct<role:string,content:string>>")
    p = rt.prompt_table(q, ctx, units, hist).first().prompt
    assert "[1] 来源: ds.pdf · 第3章 栈 · 第28页\n栈是后进先出的线性表。" in p and p.endswith("问题：什么是栈？")
    assert "导师：" + "x" * 200 + "\n" in p and "x" * 201 not in p


def test_reading_card(spark):
    rows = [(1, 1, 0, None, "parent one two"), (2, 1, 1, 1, "a"), (3, 1, 2, 1, "b"), (4, 1, 4, 1, "d")]
    chunks = spark.createDataFrame(rows, "chunk_id bigint, doc_id bigint, chunk_index int, parent_id bigint, content string").withColumn(
        "section_path", F.lit("s")).withColumn("page_no", F.lit(1))
    docs = spark.createDataFrame([(1, 9, "f.md")], "doc_id bigint, kb_id bigint, file_name string")
    got = {r.chunk_id: (r.parent_content, r.prev_content, r.next_content) for r in reading.chunk_context(chunks, docs).collect()}
    assert got == {1: (None, None, "a"), 2: ("parent one two", None, "b"), 3: ("parent one two", "a", None), 4: ("parent one two", None, None)}


def test_tiles_keep_their_best_until_they_are_done(spark, monkeypatch):
    """More tiles than the memory holds: a task sends k rows per question and share of the blocks, not k per block, and the result is that of brute force."""
    rng = np.random.default_rng(4)
    vectors = np.round(rng.normal(size=(300, 4)), 1)
    vectors[vectors.any(axis=1) == False] = 1.0  # noqa: E712
    table = spark.createDataFrame([(1, i, v.tolist()) for i, v in enumerate(vectors)], "kb_id long, chunk_id long, vector array<double>").repartition(3)
    monkeypatch.setattr(recall, "MANY_QUESTIONS", 16)
    monkeypatch.setattr(recall, "BLOCK_BYTES", 8 * 4 * 10)
    monkeypatch.setattr(recall, "STATE_BYTES", 16 * 16 * 5)
    sent = []
    monkeypatch.setattr(recall, "best_rows", lambda hits, k, cut=recall.best_rows: (sent.append(hits.count()), cut(hits, k))[1])
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {(r.q_id, r["rank"]): (r.chunk_id, r.score) for r in recall.vector_topk(table.withColumnRenamed("chunk_id", "q_id"), table, 5).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    scores = np.round(unit @ unit.T, 6) + 0.0
    want = {(q, n + 1): (int(c), scores[q, c]) for q in range(300) for n, c in enumerate(np.lexsort((np.arange(300), -scores[q]))[:5])}
    assert got == want and sent[0] <= 300 * 5 * recall.BLOCK_SHARES
