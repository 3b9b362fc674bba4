"""Queries over the library, practice records, logs, conversations and rate limits."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from askloom.operators import library as lib, limits, logs, practice
from askloom.plans import tables as t
from askloom.plans.registry import query
from askloom.session import materialize, shared_dir
from askloom.sources import sinks

# ---------------------------------------------------------------- logs


@query("a1_recent_queries", """
SELECT id, kb_id, question, latency_ms, NOT answered AS debug_only, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY kb_id ORDER BY id DESC) AS rank FROM query_log) WHERE rank <= 50""", ("query_log",))
def _(spark, sf):
    return logs.recent_queries(t.query_log(spark, sf)).drop("created_at")


@query("a2_query_profile", """
SELECT id, kb_id, CAST(k AS INTEGER) AS fused_count, chunk_id, rrf_score, coalesce(chunk_id = k, FALSE) AS chosen FROM (
  SELECT id, kb_id, k, k AS chunk_id, 0.5::DOUBLE AS rrf_score FROM query_log WHERE event_type <> 'error'
  UNION ALL SELECT id, kb_id, k, user_id, 0.25 FROM query_log WHERE event_type <> 'error'
  UNION ALL SELECT id, kb_id, k, NULL, NULL FROM query_log WHERE event_type = 'error')""".replace("UNION ALL", "UNION ALL"), ("query_log",))
def _(spark, sf):
    return logs.query_profile(t.query_log(spark, sf))


# ---------------------------------------------------------------- library


@query("a3_cascade_delete", """
SELECT 'document' AS "table", count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS checksum FROM manifest WHERE kb_id NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)
UNION ALL SELECT 'chunk', count(*), CAST(sum(l_partkey) AS BIGINT) FROM lineitem WHERE l_orderkey NOT IN (SELECT doc_id FROM manifest WHERE kb_id IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1))
UNION ALL SELECT 'kb_visitor', count(*), CAST(sum(c_custkey) AS BIGINT) FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)""", ("manifest",))
def _(spark, sf):
    gone = t.read(spark, sf, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").cast("bigint").alias("kb_id"))
    docs = t.manifest(spark, sf).select("doc_id", "kb_id")
    rows = t.read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("chunk_id"))
    visitors = t.read(spark, sf, "customer").select(F.col("c_nationkey").cast("bigint").alias("kb_id"), F.col("c_custkey").alias("visitor"))
    left = lib.cascade_delete(gone, [("document", docs, "doc_id", "", "kb_id"), ("chunk", rows, "chunk_id", "document", "doc_id"),
                                     ("kb_visitor", visitors, "visitor", "", "kb_id")])
    out = None
    for name, key in (("document", "doc_id"), ("chunk", "chunk_id"), ("kb_visitor", "visitor")):
        part = left[name].agg(F.count(F.lit(1)).alias("n"), F.sum(key).alias("checksum")).select(F.lit(name).alias("table"), "n", "checksum")
        out = part if out is None else out.unionByName(part)
    return out


@query("a4_library_readiness", """
SELECT kb_id, count(*) FILTER (status = 'READY') AS ready_count, count(*) AS doc_count, bool_or(status IN ('PENDING', 'PARSING', 'INDEXING')) AS processing FROM manifest GROUP BY kb_id""", ("manifest",))
def _(spark, sf):
    return lib.library_readiness(t.manifest(spark, sf))


def _by_language(spark, sf):
    return t.store(spark, sf).filter(F.col("status") == "READY").withColumn("kb_id", t.lang_kb(F.col("lang")))


t.cte("lang_store", f"SELECT * REPLACE ({t.SQL_LANG_KB} AS kb_id) FROM store WHERE status = 'READY'", "store")


@query("a5_chapter_rollup", """
SELECT kb_id, split_part(section_path, ' > ', 1) AS chapter, count(*) AS chunks, min(page_no) AS start_page, min(chunk_index) AS first_index
FROM lang_store WHERE section_path IS NOT NULL GROUP BY ALL""", ("lang_store",))
def _(spark, sf):
    return lib.chapter_rollup(_by_language(spark, sf))


@query("a6_chapter_names", """
SELECT kb_id, chapter, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY kb_id ORDER BY chapter) AS rank FROM (
  SELECT DISTINCT kb_id, split_part(section_path, ' > ', 1) AS chapter FROM lang_store WHERE section_path IS NOT NULL)) WHERE rank <= 4 AND trim(chapter) <> ''""", ("lang_store",))
def _(spark, sf):
    return lib.chapter_names(_by_language(spark, sf))


@query("a7_corpus_fingerprint", "SELECT kb_id, CAST(count(*) * 10000003 + coalesce(max(chunk_id), 0) AS BIGINT) AS fingerprint FROM lang_store GROUP BY kb_id", ("lang_store",))
def _(spark, sf):
    return lib.corpus_fingerprint(_by_language(spark, sf))


t.cte("lang_full", f"SELECT * REPLACE ({t.SQL_LANG_KB} AS kb_id) FROM full_store WHERE status = 'READY' AND parent_id IS NULL", "full_store")


def _sample_sql(n: int, where: str) -> str:
    return f"""
SELECT kb_id, chunk_id AS unit_id, doc_id, strategy, section_path, CAST(rn AS INTEGER) AS unit_no FROM (
  SELECT *, row_number() OVER (PARTITION BY kb_id ORDER BY md5('7|' || chunk_id), chunk_id) AS rn, count(*) OVER (PARTITION BY kb_id) AS n
  FROM lang_full WHERE {where}) WHERE rn <= {n} AND n >= 2"""


def _sampled(spark, sf, own_strategy, **scope):
    """Units of all three strategies; the first knowledge base is cut to fixed lengths, the third names no strategy."""
    docs = t.corpus(spark, sf).withColumn("kb_id", t.lang_kb(F.col("lang")))
    kb = spark.range(1, 5).select(F.col("id").alias("kb_id"), F.when(F.col("id") == 1, "FIXED").when(F.col("id") != 3, "STRUCTURE_AWARE").alias("chunk_strategy"))
    chunks = t.store(spark, sf, "FIXED", "RECURSIVE", "STRUCTURE_AWARE").drop("kb_id", "status")
    return lib.unit_scope(chunks, docs, kb if own_strategy else None, **scope)


_OWN = "strategy = CASE WHEN kb_id = 1 THEN 'FIXED' ELSE 'STRUCTURE_AWARE' END"


@query("a8_sample_units", _sample_sql(6, f"{_OWN} AND starts_with(section_path, 'src1')"), ("lang_full",))
def _(spark, sf):
    return lib.sample_units(_sampled(spark, sf, True), 6, "7", " src1 ")


@query("a8_sample_units_documents", _sample_sql(6, f"{_OWN} AND doc_id IN (SELECT doc_id FROM documents WHERE source = 'src1')"), ("lang_full",))
def _(spark, sf):
    only = t.read(spark, sf, "documents").filter("source = 'src1'").select("doc_id")
    return lib.sample_units(_sampled(spark, sf, True, only=only), 6, "7")


@query("a8_sample_units_suggest", _sample_sql(8, "TRUE"), ("lang_full",))
def _(spark, sf):
    return lib.sample_units(_sampled(spark, sf, False), 8, "7")


@query("a16_source_text", """
SELECT o.o_orderkey AS req_id, coalesce(substr(string_agg(p.p_name || chr(10) || chr(10), '' ORDER BY p.p_partkey), 1, 4000), '') AS source_text
FROM orders o LEFT JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) l ON l.l_orderkey = o.o_orderkey LEFT JOIN part p ON p.p_partkey = l.l_partkey GROUP BY ALL""")
def _(spark, sf):
    wanted = t.read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("req_id")).agg(F.collect_set("l_partkey").alias("chunk_ids"))
    requests = t.read(spark, sf, "orders").select(F.col("o_orderkey").alias("req_id")).join(wanted, "req_id", "left")
    return lib.source_text(requests, t.read(spark, sf, "part").select(F.col("p_partkey").alias("chunk_id"), F.col("p_name").alias("content")))


@query("a17_kb_listing", """
SELECT v.kb_id, v.visitor_id, kb.name, coalesce(d.n, 0) AS doc_count, kb.created_by = v.visitor_id AS is_owner,
       CAST(row_number() OVER (PARTITION BY v.visitor_id ORDER BY kb.created_at DESC, v.kb_id DESC) AS INTEGER) AS position
FROM kb_visitor v JOIN kb USING (kb_id) LEFT JOIN (SELECT kb_id, count(*) AS n FROM manifest GROUP BY ALL) d USING (kb_id)""", ("kb", "kb_visitor", "manifest"))
def _(spark, sf):
    return lib.kb_listing(t.kb(spark, sf), t.kb_visitor(spark, sf), t.manifest(spark, sf)).select("kb_id", "visitor_id", "name", "doc_count", "is_owner", "position")


def _requested(spark, sf):
    """Access requests: every order asks for the knowledge base its priority names."""
    return t.read(spark, sf, "orders").select(F.col("o_orderkey").alias("req_id"), F.concat(F.lit("v"), F.col("o_custkey").cast("string")).alias("visitor_id"),
                                              F.substring("o_orderpriority", 1, 1).cast("bigint").alias("kb_id"))


t.cte("requested", "SELECT o_orderkey AS req_id, 'v' || o_custkey AS visitor_id, CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS kb_id FROM orders")


@query("a18_accessible", "SELECT req_id, visitor_id, kb_id FROM requested SEMI JOIN kb_visitor USING (visitor_id, kb_id)", ("requested", "kb_visitor"))
def _(spark, sf):
    return lib.accessible(_requested(spark, sf), t.kb_visitor(spark, sf))


@query("a19_join_by_code", """
SELECT DISTINCT kb.kb_id, r.visitor_id FROM requested r JOIN kb b ON b.kb_id = r.kb_id JOIN kb ON kb.share_code = b.share_code
WHERE NOT EXISTS (SELECT 1 FROM kb_visitor v WHERE v.kb_id = kb.kb_id AND v.visitor_id = r.visitor_id)""", ("requested", "kb", "kb_visitor"))
def _(spark, sf):
    codes = t.kb(spark, sf).select("kb_id", F.concat(F.lit(" "), F.lower("share_code"), F.lit("\n")).alias("code"))
    return lib.join_by_code(_requested(spark, sf).join(codes, "kb_id").select("visitor_id", "code"), t.kb(spark, sf), t.kb_visitor(spark, sf))


@query("a20_documents_by_kb", "SELECT m.doc_id, m.kb_id, m.status, c.n AS doc_count, CAST(row_number() OVER (PARTITION BY m.kb_id ORDER BY m.created_at DESC, m.doc_id DESC) AS INTEGER) AS position FROM manifest m JOIN (SELECT kb_id, count(*) AS n FROM manifest GROUP BY ALL) c USING (kb_id)", ("manifest",))
def _(spark, sf):
    docs = t.manifest(spark, sf)
    return lib.documents_by_kb(docs).select("doc_id", "kb_id", "status", "position").join(lib.document_counts(docs), "kb_id")


@query("a22_recover_interrupted", """
SELECT doc_id, CASE WHEN status IN ('PENDING', 'PARSING', 'INDEXING') THEN 'FAILED' ELSE status END AS status,
       CASE WHEN status IN ('PENDING', 'PARSING', 'INDEXING') THEN '服务重启导致解析中断，请删除后重新上传' END AS error_msg FROM manifest""", ("manifest",))
def _(spark, sf):
    return lib.recover_interrupted(t.manifest(spark, sf)).select("doc_id", "status", "error_msg")


_CHUNKS_SQL = """
SELECT doc_id, strategy, chunk_index, kind, md5(content) AS content_md5 FROM (
  SELECT doc_id, strategy, chunk_index, kind, content FROM fixed_chunks UNION SELECT doc_id, strategy, chunk_index, kind, content FROM doc_chunks)"""


def _written_chunks(spark, sf):
    """Write structure chunks, then fixed chunks, then the structure chunks of the German documents again."""
    path = f"{shared_dir(spark)}/askloom/{spark.sparkContext.applicationId}/chunks-{uuid.uuid4().hex}"
    german = t.corpus(spark, sf).filter(F.col("lang") == "de").select("doc_id")
    sinks.write_chunks(t.chunks(spark, sf, "STRUCTURE_AWARE"), path)
    sinks.write_chunks(t.chunks(spark, sf, "FIXED"), path)
    sinks.write_chunks(sinks.read_chunks(spark, path).filter(F.col("strategy") == "STRUCTURE_AWARE").join(german, "doc_id", "left_semi"), path)
    return path


def _stored_chunks(spark, path):
    return sinks.read_chunks(spark, path).select("doc_id", "strategy", "chunk_index", "kind", F.md5(F.col("content").cast("binary")).alias("content_md5"))


@query("s4_write_chunks", _CHUNKS_SQL, ("fixed_chunks", "doc_chunks"))
def _(spark, sf):
    return _stored_chunks(spark, _written_chunks(spark, sf))


@query("s4_compact_chunks", _CHUNKS_SQL, ("fixed_chunks", "doc_chunks"))
def _(spark, sf):
    path = _written_chunks(spark, sf)
    store = sinks.chunk_store(spark, path)
    store.compact()
    store.expire()
    return _stored_chunks(spark, path)


# ---------------------------------------------------------------- practice


def _quizzes(spark, sf):
    """Generated quizzes: the lines of an order are questions, its parts are the units, one source number points nowhere."""
    items = t.attempt_items(spark, sf).groupBy(F.col("attempt_id").alias("quiz_id")).agg(F.array_sort(F.collect_list(F.struct("at", "question"))).alias("xs"))
    questions = F.transform("xs", lambda x, i: F.struct(
        x["question"]["type"].alias("type"), x["question"]["stem"].alias("stem"), x["question"]["answer"].alias("answer"),
        F.array(i + 1, F.lit(0), F.lit(99)).alias("sourceNos")))
    return items.select("quiz_id", F.to_json(F.struct(questions.alias("questions"))).alias("quiz"),
                        F.transform("xs", lambda x: x["at"]["l_partkey"]).alias("unit_ids"))


@query("a9_source_no_to_chunk", """
SELECT attempt_id AS quiz_id, CAST(idx AS INTEGER) AS pos, type, stem, answer, CAST(l_partkey AS VARCHAR) AS source_chunk_ids
FROM attempt_items WHERE attempt_id IN (SELECT attempt_id FROM attempt_items GROUP BY ALL HAVING count(*) >= 3)""", ("attempt_items",))
def _(spark, sf):
    rows = practice.source_no_to_chunk(_quizzes(spark, sf))
    return rows.withColumn("source_chunk_ids", F.array_join(F.col("source_chunk_ids").cast("array<string>"), ","))


@query("a10_grade_choice", """
SELECT attempt_id, idx, trim(user_answer) = lower(answer) AS correct, CAST(CASE WHEN trim(user_answer) = lower(answer) THEN 100 ELSE 0 END AS INTEGER) AS score,
       CASE WHEN trim(user_answer) = lower(answer) THEN '答对了。' ELSE '正确答案是 ' || answer || '。' END || explanation AS comment FROM attempt_items WHERE type = 'single'""", ("attempt_items",))
def _(spark, sf):
    from askloom.functions.arrays import rows_of
    from askloom.schemas import ANSWERS_JSON, QUESTIONS_JSON
    a = t.attempts(spark, sf)
    zipped = F.arrays_zip(F.from_json("questions", QUESTIONS_JSON).alias("q"), F.from_json("answers", ANSWERS_JSON).alias("a"))
    rows = rows_of(a, zipped, "attempt_id", pos="idx").select("attempt_id", F.col("idx").cast("bigint").alias("idx"), "item.q.*", F.col("item.a").alias("user_answer"))
    return practice.grade_choice(rows).select("attempt_id", "idx", "correct", "score", "comment")


@query("a10_clamp_score", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, greatest(0, least(100, CAST(l_quantity AS INTEGER) * 4 - 50)) AS score FROM lineitem")
def _(spark, sf):
    rows = t.read(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", (F.col("l_quantity").cast("int") * 4 - 50).alias("score"))
    return practice.clamp_score(rows)


@query("a11_eval_set_edit", """
SELECT q_id, kb_id, 'kept' AS outcome, CAST(row_number() OVER (PARTITION BY kb_id ORDER BY q_id DESC) AS INTEGER) AS position FROM (
  SELECT o_orderkey AS q_id, CAST(o_custkey % 7 AS BIGINT) AS kb_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 50) OR o_custkey % 7 = 0)
UNION ALL SELECT DISTINCT l_orderkey, CAST(o_custkey % 7 AS BIGINT) + CASE WHEN o_custkey % 7 = 0 THEN 100 ELSE 0 END, 'missing', NULL::INTEGER FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_quantity >= 50 AND o_custkey % 7 = 0""".replace("UNION ALL", "UNION"))
def _(spark, sf):
    kb = (F.col("o_custkey") % 7).cast("bigint")
    asked = t.read(spark, sf, "orders").select(F.col("o_orderkey").alias("q_id"), kb.alias("kb_id"))
    big = t.read(spark, sf, "lineitem").filter("l_quantity >= 50").select(F.col("l_orderkey").alias("q_id")).distinct()
    deletes = asked.join(big, "q_id").withColumn("kb_id", F.when(F.col("kb_id") == 0, 100).otherwise(F.col("kb_id")).cast("bigint"))
    left, missing = practice.edit_eval_set(asked, deletes)
    return left.withColumn("outcome", F.lit("kept")).unionByName(missing.withColumns({"outcome": F.lit("missing"), "position": F.lit(None).cast("int")}))


@query("a12_attempt_total", "SELECT attempt_id, CAST(total // n AS INTEGER) AS total_score FROM attempts", ("attempts",))
def _(spark, sf):
    return practice.attempt_total(t.attempts(spark, sf)).select("attempt_id", "total_score")


@query("a13_attempt_summary", """
SELECT attempt_id, kb_id, visitor_id, CAST(n AS INTEGER) AS question_count, CAST(wrong AS INTEGER) AS wrong_count FROM (
  SELECT *, row_number() OVER (PARTITION BY kb_id, visitor_id ORDER BY attempt_id DESC) AS rn FROM attempts) WHERE rn <= 20""", ("attempts",))
def _(spark, sf):
    return practice.attempt_summary(t.attempts(spark, sf)).select("attempt_id", "kb_id", "visitor_id", "question_count", "wrong_count")


@query("a14_wrong_book", """
SELECT kb_id, visitor_id, attempt_id, created_at, CAST(idx AS INTEGER) AS question_index, type, stem, 'A|N|R' AS options, answer, explanation, score, 'graded' AS comment,
       CASE WHEN score < 30 THEN stem || '|line' ELSE '' END AS missed_sentences, user_answer, CAST(rn AS INTEGER) AS rank FROM (
  SELECT a.*, i.* EXCLUDE (attempt_id), row_number() OVER (PARTITION BY kb_id, visitor_id ORDER BY a.attempt_id DESC, idx) AS rn
  FROM attempts a JOIN attempt_items i ON i.attempt_id = a.attempt_id WHERE i.score < 60) WHERE rn <= 50""", ("attempts", "attempt_items"))
def _(spark, sf):
    return practice.wrong_book(t.attempts(spark, sf)).withColumns({c: F.array_join(c, "|") for c in ("options", "missed_sentences")})


@query("a15_mark_mastered", """
SELECT attempt_id, CAST(sum(CASE WHEN l_partkey % 2 = 0 AND score < 60 THEN 100 ELSE score END) AS INTEGER) AS total, count(*) FILTER (score < 60 AND l_partkey % 2 = 1) AS wrong_count
FROM attempt_items JOIN attempts USING (attempt_id) GROUP BY attempt_id""", ("attempts", "attempt_items"))
def _(spark, sf):
    from askloom.functions.arrays import rows_of
    a = materialize(practice.typed(t.attempts(spark, sf)).select("attempt_id", "questions", "grades"), "attempts-typed")
    zipped = F.arrays_zip(F.col("questions").alias("q"), F.col("grades").alias("g"))
    wrong = rows_of(a, zipped, "attempt_id", pos="question_index").filter("item.g.score < 60 and item.q.sourceChunkIds[0] % 2 = 0").select("attempt_id", "question_index")
    updates = wrong.unionByName(wrong.withColumn("question_index", F.col("question_index") + 1000))
    return practice.mark_mastered(a, updates).select(
        "attempt_id", F.aggregate("grades", F.lit(0), lambda s, g: s + g["score"]).alias("total"),
        F.size(F.filter("grades", lambda g: g["score"] < 60)).cast("bigint").alias("wrong_count"))


@query("a21_attempt_detail", """
SELECT o.o_orderkey AS attempt_id, CASE WHEN a.attempt_id IS NULL THEN 'missing' ELSE 'found' END AS outcome
FROM orders o LEFT JOIN attempts a ON a.attempt_id = o.o_orderkey AND a.kb_id = CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AND a.visitor_id = 'v' || o.o_custkey""", ("attempts",))
def _(spark, sf):
    keys = _requested(spark, sf).withColumnRenamed("req_id", "attempt_id")
    found, missing = practice.attempt_detail(t.attempts(spark, sf), keys)
    return found.select("attempt_id", F.lit("found").alias("outcome")).unionByName(missing.select("attempt_id", F.lit("missing").alias("outcome")))


# ---------------------------------------------------------------- conversations


@query("a23_conversation_listing", """
SELECT conv_id, kb_id, visitor_id, title, CAST(rn AS INTEGER) AS rank, m.n AS msg_count FROM (
  SELECT *, row_number() OVER (PARTITION BY kb_id, visitor_id ORDER BY updated_at DESC, conv_id DESC) AS rn FROM conv)
JOIN (SELECT conv_id, count(*) AS n FROM conversations GROUP BY ALL) m USING (conv_id) WHERE rn <= 30""", ("conv",))
def _(spark, sf):
    return logs.conversation_listing(t.conversations(spark, sf), t.messages(spark, sf)).drop("updated_at")


@query("a24_conversation_messages", "SELECT conv_id, turn, role, text AS content, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS position FROM conversations")
def _(spark, sf):
    return logs.conversation_messages(t.messages(spark, sf))


@query("a25_first_question_flag", """
SELECT conv_id, turn, role, count(*) FILTER (role = 'user') OVER (PARTITION BY conv_id ORDER BY turn) <= 1 AS first_question FROM conversations""")
def _(spark, sf):
    return logs.first_question_flag(t.messages(spark, sf)).drop("content")


@query("a26_touch_updated_at", """
SELECT c.conv_id, greatest(c.updated_at, m.latest) AS updated_at FROM conv c
JOIN (SELECT conv_id, max(make_timestamp((1700000000 + turn * 60)::BIGINT * 1000000)) AS latest FROM conversations GROUP BY ALL) m USING (conv_id)""", ("conv",))
def _(spark, sf):
    written = t.messages(spark, sf).withColumn("created_at", F.timestamp_seconds(F.lit(1700000000) + F.col("turn") * 60))
    return logs.touch_updated_at(t.conversations(spark, sf), written).select("conv_id", "updated_at")


# ---------------------------------------------------------------- limits


@query("t1_limit_per_day", """
SELECT event_id, user_id, CAST(ts AS DATE) AS day, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) <= 5 AS allowed FROM events""")
def _(spark, sf):
    return limits.limit_per_day(t.read(spark, sf, "events"), "user_id", 5).select("event_id", "user_id", "day", "allowed")


t.cte("hits_in_order", "SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events")
t.cte("anchored", """
SELECT event_id, user_id, k, ts AS anchor, 1::BIGINT AS hit_no, ts FROM hits_in_order WHERE k = 1
UNION ALL
SELECT h.event_id, h.user_id, h.k, CASE WHEN h.ts < a.anchor + INTERVAL 12 HOUR THEN a.anchor ELSE h.ts END,
       CASE WHEN h.ts < a.anchor + INTERVAL 12 HOUR THEN a.hit_no + 1 ELSE 1 END, h.ts FROM anchored a JOIN hits_in_order h ON h.user_id = a.user_id AND h.k = a.k + 1""", "hits_in_order")


@query("t2_limit_anchored", "SELECT event_id, user_id, anchor, hit_no, hit_no <= 2 AS allowed FROM anchored", ("anchored",))
def _(spark, sf):
    return limits.limit_anchored(t.read(spark, sf, "events"), "user_id", 2, 12 * 3600).select("event_id", "user_id", "anchor", "hit_no", "allowed")
