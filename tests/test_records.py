"""Typed attempts, sample scope, listing positions, postings in the row, the Bloom filter, page layout against plain Python, stored runs."""

import json
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from askloom.functions import ranking
from askloom.operators import evaluation as ev, indexing, library as lib, logs, pagelayout, practice, retrieval
from askloom.sources import sinks


def attempts(spark):
    def q(stem):
        return {"type": "single", "stem": stem, "options": ["a", "b"], "answer": "a", "explanation": "e", "sourceChunkIds": [1]}

    def g(i, score, missed=()):
        return {"index": i, "type": "single", "correct": score >= 60, "score": score, "comment": f"c{i}", "missedSentences": list(missed)}
    rows = [(1, 5, "v", "t", json.dumps([q("s0"), q("s1")]), json.dumps(["x", "y"]), json.dumps([g(0, 10, ["m"]), g(1, 90)])),
            (2, 5, "v", "t", json.dumps([q("s2")]), json.dumps(["z"]), json.dumps([g(0, 59)])), (3, 5, "v", "t", "broken{", "[]", "[]"), (4, 5, "v", "t", None, None, None)]
    return spark.createDataFrame(rows, "attempt_id bigint, kb_id bigint, visitor_id string, created_at string, questions string, answers string, grades string")


def test_typed_and_text_attempts_agree(spark):
    text = attempts(spark)
    typed = practice.typed(text)
    assert practice.typed(typed).schema == typed.schema and dict(typed.dtypes)["answers"] == "array<string>"
    for form in (text, typed):
        wrong = [(r.attempt_id, r.question_index, r.stem, r.options, r.missed_sentences, r.user_answer, r["rank"]) for r in practice.wrong_book(form).orderBy("rank").collect()]
        assert wrong == [(2, 0, "s2", ["a", "b"], [], "z", 1), (1, 0, "s0", ["a", "b"], ["m"], "x", 2)]
        assert {r.attempt_id: r.total_score for r in practice.attempt_total(form).collect()} == {1: 50, 2: 59, 3: 0, 4: None}
        assert {r.attempt_id: (r.question_count, r.wrong_count) for r in practice.attempt_summary(form).collect() if r.attempt_id < 3} == {1: (2, 1), 2: (1, 1)}
        marked = practice.mark_mastered(form, spark.createDataFrame([(1, 0), (1, 99), (9, 0)], "attempt_id bigint, question_index int"))
        assert marked.schema["grades"].dataType == form.schema["grades"].dataType
        assert {r.attempt_id for r in practice.wrong_book(marked).collect()} == {2}


def test_unit_scope(spark):
    chunks = spark.createDataFrame([(1, "FIXED", 10, None, "p"), (1, "STRUCTURE_AWARE", 11, None, "p"), (1, "STRUCTURE_AWARE", 12, 11, "p"), (2, "STRUCTURE_AWARE", 20, None, "q"),
                                    (3, "STRUCTURE_AWARE", 30, None, "q")], "doc_id bigint, strategy string, chunk_id bigint, parent_id bigint, section_path string")
    docs = spark.createDataFrame([(1, 7, "READY"), (2, 8, "READY"), (3, 8, "FAILED")], "doc_id bigint, kb_id bigint, status string")
    kb = spark.createDataFrame([(7, "FIXED"), (8, None)], "kb_id bigint, chunk_strategy string")

    def ids(**scope):
        return {r.unit_id for r in lib.unit_scope(chunks, docs, **scope).collect()}

    assert ids() == {10, 11, 20} and ids(kb=kb) == {10, 20}
    only = spark.createDataFrame([(1,), (1,), (3,)], "doc_id bigint")
    assert ids(only=only) == {10, 11} and ids(kb=kb, only=only) == {10}


def test_positions(spark):
    docs = spark.createDataFrame([(1, 1, 5), (2, 1, 9), (3, 1, 9), (4, 2, 1)], "doc_id bigint, kb_id bigint, created_at bigint")
    assert {r.doc_id: r.position for r in lib.documents_by_kb(docs).collect()} == {3: 1, 2: 2, 1: 3, 4: 1}
    turns = spark.createDataFrame([(1, 7), (1, 3), (2, 0)], "conv_id bigint, turn bigint")
    assert {(r.conv_id, r.turn): r.position for r in logs.conversation_messages(turns).collect()} == {(1, 3): 1, (1, 7): 2, (2, 0): 1}
    left, missing = practice.edit_eval_set(spark.createDataFrame([(1, 1), (5, 1), (3, 1), (4, 2)], "q_id bigint, kb_id bigint"),
                                           spark.createDataFrame([(3, 1), (4, 1)], "q_id bigint, kb_id bigint"))
    assert {r.q_id: r.position for r in left.collect()} == {5: 1, 1: 2, 4: 1} and [r.q_id for r in missing.collect()] == [4]


def test_postings_in_the_row(spark):
    rows = [(1, "child", "b a b. A ünd B"), (2, "child", ""), (3, "child", None), (4, "parent", "x"), (5, "child", "数据库")]
    chunks = spark.createDataFrame(rows, "chunk_id bigint, kind string, content string")
    found = indexing.build_postings(chunks, "chunk_id")
    assert {(r.chunk_id, r.term): (r.tf, r.positions) for r in found.collect() if r.chunk_id == 1} == {
        (1, "a"): (2, [2, 4]), (1, "b"): (3, [1, 3, 6]), (1, "ünd"): (1, [5])}
    assert {r.chunk_id for r in found.collect()} == {1, 5}
    assert {(r.term, r.tf) for r in indexing.term_counts(chunks, "chunk_id").filter("chunk_id = 5").collect()} == {(x, 1) for x in ("数", "据", "库", "数据", "据库")}
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_bloom_filter_loses_nothing(spark):
    have, asked = spark.range(0, 3000, 3).select(F.col("id").cast("string").alias("v")), spark.range(3000).select(F.col("id").cast("string").alias("v"))
    for bits, most in ((1 << 16, 200), (64, 2000)):
        passed = {int(r.v) for r in asked.filter(ranking.might_hold(ranking.bloom_filter(have, F.col("v"), bits), F.col("v"), bits)).collect()}
        assert set(range(0, 3000, 3)) <= passed and len(passed) - 1000 <= most
    none = have.filter("false")
    assert asked.filter(ranking.might_hold(ranking.bloom_filter(none, F.col("v")), F.col("v"))).count() == 0


def test_corpus_shingles_meet_the_filter_before_the_shuffle(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = spark.createDataFrame([(1, "abcdefghijklmnop")], "item bigint, text string")
        right = spark.createDataFrame([(7, "zz abcdefghijklmnop zz" + "other text " * 50)], "doc bigint, text string")
        df = ev.shingle_coverage(left, right, "item", "doc")
        assert [(r.item, r.doc, r.shared) for r in df.collect()] == [(1, 7, 7)]
        assert "scalar-subquery" in df._jdf.queryExecution().executedPlan().toString().lower().replace("scalarsubquery", "scalar-subquery").replace("subquery#", "scalar-subquery#")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def layout_by_hand(lines):
    """Elements of one document's lines (line_no, page, page_count, font, text), by the rules of the product."""
    lines = [x for x in sorted(lines) if x[4].strip("".join(map(chr, range(33))))]
    edges = []
    for p in {x[1] for x in lines}:
        page = [x for x in lines if x[1] == p]
        edges += [page[0], page[-1]]

    def norm(t):
        return re.sub(r"[ \t\n\x0b\f\r]+", "", re.sub(r"[0-9]+", "#", t))
    times = Counter(norm(x[4]) for x in edges)
    least = max(2, -(-lines[0][2] * 6 // 10)) if lines else 2
    gone = {x[0] for x in edges if times[norm(x[4])] >= least or (len(x[4].strip()) <= 8 and re.fullmatch(r"[0-9ivxIVX\-–—/ .]+", x[4].strip()))}
    fonts = [int(x[3] + 0.5) for x in lines]
    count = Counter(fonts)
    last = {f: x[0] for f, x in zip(fonts, lines, strict=True)}
    body = min(count, key=lambda f: (-count[f], last[f])) if fonts else 10
    body = 10 if body == 0 else body
    kept = [x for x in lines if x[0] not in gone]

    def heading(x):
        t = x[4]
        if not (x[3] > body * 1.15 and len(t) <= 40 and sum(c.isalpha() or c.isdecimal() for c in t) >= len(t) * 0.5):
            return False
        han, latin = len(re.findall("[一-鿿]", t)), len(re.findall("[a-zA-Z]", t))
        return han >= 2 or (latin >= 4 and not re.search(r"[=+×÷^~≤≥∈∫∑|&]", t))
    ranks = sorted({x[3] for x in kept if heading(x)}, reverse=True)
    out, open_block = [], False
    for x in kept:
        if re.match(r"^.*[.·…]{2,}\s*\d{1,4}\s*$", x[4]) and len(x[4]) <= 80:
            continue
        if heading(x):
            out.append(["HEADING", x[4], min(ranks.index(x[3]) + 1, 4), x[1]])
            open_block = False
            continue
        if open_block:
            gap = " " if re.search(r"[A-Za-z0-9]$", out[-1][1]) and re.match(r"[A-Za-z0-9]", x[4]) else ""
            out[-1][1] += gap + x[4]
        else:
            out.append(["PARAGRAPH", x[4], 0, x[1]])
        open_block = not re.search(r"[。！？；：!?;:.]$", x[4])
    return [(i, *e) for i, e in enumerate(out)]


def test_layout_against_plain_python(spark):
    rng = random.Random(8)
    pool = ["Chapter heading", "第一章 绪论", "a = b + c", "plain body text that goes on", "ends here.", "Contents ..... 12", "12", "  ", "iv", "x", "MORE Titles", "结束。"]
    rows = []
    for doc in range(40):
        pages = rng.randrange(1, 6)
        for p in range(1, pages + 1):
            texts = [rng.choice(["Running head 1", "Running head 2", "other"])] + [rng.choice(pool) for _ in range(rng.randrange(0, 7))] + [rng.choice([f"{p}", f"page {p}", "foot"])]
            rows += [(doc, p * 100 + i, p, pages, float(rng.choice([0.2, 10, 10.4, 11, 14, 16, 18, 20, 22])), t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id bigint, line_no int, page int, page_count int, max_font double, text string")
    got = {}
    for r in pagelayout.layout_elements(df).orderBy("doc_id", "pos").collect():
        got.setdefault(r.doc_id, []).append((r.pos, r.type, r.text, r.level, r.page_no))
    want = {d: layout_by_hand([(n, p, c, f, t) for doc, n, p, c, f, t in rows if doc == d]) for d in range(40)}
    assert got == {d: e for d, e in want.items() if e}
    steps = pagelayout.merge_paragraphs(pagelayout.classify_lines(df))
    assert sorted(map(tuple, steps.collect())) == sorted((d, *e) for d, es in want.items() for e in es)
    plan = pagelayout.layout_elements(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_locate_skips_blank_questions_and_lost_texts_score_null(spark):
    questions = spark.createDataFrame([(1, "what"), (2, " \n")], "q_id bigint, question string")
    fused = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 10, 1)], "q_id bigint, chunk_id bigint, rrf_rank int")
    chunks = spark.createDataFrame([(10, "f", "s", 1, "what is this")], "chunk_id bigint, file_name string, section_path string, page_no int, content string")
    scored = retrieval.score_pairs(fused, questions, chunks, retrieval.coverage_scorer())
    assert {(r.q_id, r.chunk_id): r.rerank_score is None for r in scored.collect()} == {(1, 10): False, (1, 11): True, (2, 10): False}
    kept = retrieval.rerank(scored)
    assert [(r.q_id, r.chunk_id, r.snippet, r.score) for r in retrieval.locate(questions, kept, chunks).collect()] == [(1, 10, "what is this", None)]


@pytest.mark.parametrize("answered", [True, False])
def test_log_rows_carry_the_answer(spark, answered):
    questions = spark.createDataFrame([(1, 9, "q")], "q_id bigint, kb_id bigint, question string")
    detail = spark.createDataFrame([(1, 1, (5, "f"))], "q_id bigint, rank int, candidate struct<chunkId:bigint,file:string>")
    context = spark.createDataFrame([(1, 2, 50), (1, 1, 60)], "q_id bigint, block_no int, unit_id bigint")
    meta = spark.createDataFrame([(1, 1, 2, 3, 4)], "q_id bigint, vectorCount int, ftsCount int, fusedCount int, rerankCount int")
    answers = spark.createDataFrame([(1, "v1", "a", 12, 3, 4, "t")] if answered else [],
                                    "q_id bigint, visitor_id string, answer string, latency_ms bigint, prompt_tokens bigint, completion_tokens bigint, created_at string")
    r = sinks.query_log_rows(questions, detail, context, meta, answers).first()
    assert (r.id, r.kb_id, r.chosen_ids, json.loads(r.retrieved)[0]["chunkId"], json.loads(r.retrieval_meta)["rerankCount"]) == (1, 9, [60, 50], 5, 4)
    assert (r.visitor_id, r.answer, r.latency_ms, r.prompt_tokens, r.completion_tokens) == (("v1", "a", 12, 3, 4) if answered else (None,) * 5)
