"""Queries over recall, fusion, reranking, context and reading cards."""

from __future__ import annotations

from pyspark.sql import functions as F

from askloom.operators import indexing, reading, retrieval
from askloom.plans import tables as t
from askloom.plans.registry import query


@query("r1_searchable", "SELECT chunk_id, doc_id, kb_id, file_name FROM full_ready WHERE strategy = 'STRUCTURE_AWARE'", ("full_ready",))
def _(spark, sf):
    docs = t.corpus(spark, sf).select("doc_id", "kb_id", "file_name", "status")
    rows = t.store(spark, sf, "FIXED", "STRUCTURE_AWARE").drop("kb_id", "file_name", "status")
    return retrieval.searchable(rows, docs, "STRUCTURE_AWARE").select("chunk_id", "doc_id", "kb_id", "file_name")


_VECTOR_SQL = """
SELECT q_id, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, chunk_id) AS rank FROM (
    SELECT q.item_id AS q_id, c.vec_id AS chunk_id, round(list_cosine_similarity(v.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) + 0 AS score
    FROM benchmark q JOIN embeddings v ON v.vec_id = q.item_id, embeddings c)) WHERE rank <= 50"""


def _vectors(spark, sf):
    e = t.read(spark, sf, "embeddings")
    stored = e.select(F.lit(1).alias("kb_id"), F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    asked = t.questions(spark, sf).join(e.select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("vector")), "q_id")
    return asked, stored


@query("r2_vector_topk", _VECTOR_SQL)
def _(spark, sf):
    return retrieval.vector_topk(*_vectors(spark, sf))


@query("r2_vector_topk_many_questions", """
SELECT q_id, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, chunk_id) AS rank FROM (
    SELECT q.vec_id AS q_id, c.vec_id AS chunk_id, round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) + 0 AS score
    FROM embeddings q, embeddings c)) WHERE rank <= 50""")
def _(spark, sf):
    """Every stored vector asks for its neighbours."""
    stored = _vectors(spark, sf)[1]
    return retrieval.vector_topk(stored.withColumnRenamed("chunk_id", "q_id"), stored)


@query("r2_vector_recall_text", "SELECT q_id, chunk_id, score, rank FROM r_vec", ("r_vec",))
def _(spark, sf):
    return t.Funnel(spark, sf).vector


@query("r4_query_terms", "SELECT q_id, CAST(1 AS BIGINT) AS kb_id, term FROM q_terms_tf", ("q_terms_tf",))
def _(spark, sf):
    return retrieval.query_terms(t.questions(spark, sf))


@query("r5_keyword_topk", "SELECT q_id, chunk_id, score, rank FROM r_kw", ("r_kw",))
def _(spark, sf):
    return t.Funnel(spark, sf).keyword


@query("r5_keyword_topk_no_index", "SELECT q_id, chunk_id, score, rank FROM r_kw", ("r_kw",))
def _(spark, sf):
    terms = retrieval.query_terms(t.questions(spark, sf))
    return retrieval.keyword_topk(terms, indexing.asked_term_counts(t.searchable(spark, sf), terms, "kb_id", "chunk_id"))


@query("r5_keyword_topk_bm25", """
SELECT q_id, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, chunk_id) AS rank FROM (
    SELECT q_id, chunk_id, round(sum(ln(1 + (s.n - d.df + 0.5::DOUBLE) / (d.df + 0.5::DOUBLE)) * t.tf * 2.2::DOUBLE
             / (t.tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l.len / s.avg_len))), 6) AS score
    FROM r_terms t JOIN q_terms_tf q USING (term) JOIN (SELECT term, count(*) AS df FROM r_terms GROUP BY ALL) d USING (term)
    JOIN (SELECT chunk_id, sum(tf)::DOUBLE AS len FROM r_terms GROUP BY ALL) l USING (chunk_id)
    CROSS JOIN (SELECT count(*)::DOUBLE AS n, avg(len) AS avg_len FROM (SELECT chunk_id, sum(tf)::DOUBLE AS len FROM r_terms GROUP BY ALL)) s
    GROUP BY ALL)) WHERE rank <= 50""", ("r_terms", "q_terms_tf"))
def _(spark, sf):
    return retrieval.bm25_topk(retrieval.query_terms(t.questions(spark, sf)), t.postings(spark, sf).drop("strategy"))


_FUSED = "q_id, chunk_id, round(vector_score, 6) AS vector_score, vector_rank, round(fts_score, 6) AS fts_score, fts_rank, round(rrf_score, 6) AS rrf_score, rrf_rank"


def _rounded(df, *extra):
    return df.select("q_id", "chunk_id", "vector_score", "vector_rank", "fts_score", "fts_rank", F.round("rrf_score", 6).alias("rrf_score"), "rrf_rank", *extra)


@query("r6_rrf_fuse", f"SELECT {_FUSED} FROM r_fused", ("r_fused",))
def _(spark, sf):
    return _rounded(t.Funnel(spark, sf).fused)


@query("r7_vector_only", """
SELECT q_id, chunk_id, score AS vector_score, rank AS vector_rank, CAST(NULL AS DOUBLE) AS fts_score, CAST(NULL AS INTEGER) AS fts_rank,
       round(1.0::DOUBLE / (60 + rank), 6) AS rrf_score, rank AS rrf_rank FROM r_vec WHERE rank <= 30""", ("r_vec",))
def _(spark, sf):
    return _rounded(retrieval.vector_only(t.Funnel(spark, sf).vector))


@query("r8_rerank", f"SELECT {_FUSED}, rerank_score, rank FROM r_top", ("r_top",))
def _(spark, sf):
    return _rounded(t.Funnel(spark, sf).reranked, "rerank_score", "rank")


@query("r9_pair_score", "SELECT q_id, chunk_id, rrf_rank, rerank_score FROM r_scored", ("r_scored",))
def _(spark, sf):
    return t.Funnel(spark, sf).scored.select("q_id", "chunk_id", "rrf_rank", "rerank_score")


@query("r10_rerank_fallback", """
SELECT q_id, chunk_id, CASE WHEN failed THEN NULL ELSE rerank_score END AS rerank_score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY CASE WHEN failed THEN NULL ELSE rerank_score END DESC NULLS LAST, rrf_rank) AS rank
  FROM (SELECT *, bool_or(chunk_id % 2 = 1) OVER (PARTITION BY q_id) AS failed FROM r_scored)) WHERE rank <= 8""", ("r_scored",))
def _(spark, sf):
    scored = t.Funnel(spark, sf).scored
    broken = F.when(F.col("chunk_id") % 2 == 0, F.col("rerank_score"))
    return retrieval.rerank(scored.withColumn("rerank_score", broken)).select("q_id", "chunk_id", "rerank_score", "rank")


t.cte("refusals", """
SELECT q.q_id, x.rerank_score AS top_score, CASE WHEN x.q_id IS NULL THEN TRUE ELSE x.rerank_score < 0.35 END AS refused
FROM questions q LEFT JOIN (SELECT * FROM r_top WHERE rank = 1) x USING (q_id)""", "questions", "r_top")


@query("r11_refuse", "SELECT q_id, top_score, refused FROM refusals", ("refusals",))
def _(spark, sf):
    f = t.Funnel(spark, sf)
    return retrieval.refuse(f.questions, f.reranked)


t.cte("units", """
SELECT q_id, row_number() OVER (PARTITION BY q_id ORDER BY rank) AS k, unit_id, tokens, chunk_id FROM (
  SELECT r.q_id, coalesce(s.parent_id, s.chunk_id) AS unit_id, min(r.rank) AS rank, arg_min(r.chunk_id, r.rank) AS chunk_id,
         arg_min(coalesce(p.token_count, s.token_count), r.rank) AS tokens
  FROM r_top r JOIN store s USING (chunk_id) LEFT JOIN store p ON p.chunk_id = s.parent_id GROUP BY ALL)""", "r_top", "store")
t.cte("context_fold", """
SELECT q_id, 0::BIGINT AS k, 0::BIGINT AS used, 0::BIGINT AS blocks, FALSE AS taken FROM (SELECT DISTINCT q_id FROM units)
UNION ALL
SELECT u.q_id, u.k, CASE WHEN f.blocks < 4 AND f.used + u.tokens <= 3000 THEN f.used + u.tokens ELSE f.used END,
       CASE WHEN f.blocks < 4 AND f.used + u.tokens <= 3000 THEN f.blocks + 1 ELSE f.blocks END, f.blocks < 4 AND f.used + u.tokens <= 3000
FROM context_fold f JOIN units u ON u.q_id = f.q_id AND u.k = f.k + 1""", "units")
t.cte("context", """
SELECT q_id, CAST(f.blocks AS INTEGER) AS block_no, u.unit_id, u.chunk_id, CAST(u.tokens AS INTEGER) AS tokens FROM context_fold f JOIN units u USING (q_id, k) WHERE f.taken""", "context_fold")


@query("r12_assemble_context", "SELECT q_id, block_no, unit_id, chunk_id, tokens FROM context", ("context",))
def _(spark, sf):
    return t.Funnel(spark, sf).context.drop("is_parent")


@query("r13_candidate_detail", f"""
SELECT q_id, r.rrf_rank AS rank, r.chunk_id, file_name AS file, section_path AS section, page_no AS page, {t.sql_snippet('content', 300)} AS snippet, token_count,
       round(vector_score, 4) AS vector_score, round(fts_score, 4) AS fts_score, round(rrf_score, 4) AS rrf_score, round(rerank_score, 4) AS rerank_score
FROM r_scored r JOIN store USING (chunk_id)""", ("r_scored", "store"))
def _(spark, sf):
    f = t.Funnel(spark, sf)
    c = F.col("candidate")
    return retrieval.candidate_detail(f.scored.withColumn("rank", F.col("rrf_rank")), f.chunks).select(
        "q_id", "rank", c.chunkId.alias("chunk_id"), c.file.alias("file"), c.section.alias("section"), c.page.alias("page"), c.snippet.alias("snippet"),
        c.tokenCount.alias("token_count"), c.vectorScore.alias("vector_score"), c.ftsScore.alias("fts_score"), c.rrfScore.alias("rrf_score"), c.rerankScore.alias("rerank_score"))


@query("r14_snippet", f"SELECT doc_id, {t.sql_snippet('text', 80)} AS s80, {t.sql_snippet('text', 300)} AS s300 FROM documents")
def _(spark, sf):
    from askloom.functions.text import snippet
    return t.read(spark, sf, "documents").select("doc_id", snippet(F.col("text"), 80).alias("s80"), snippet(F.col("text"), 300).alias("s300"))


@query("r15_funnel_meta", """
SELECT q_id, coalesce(v.n, 0) AS "vectorCount", coalesce(k.n, 0) AS "ftsCount", coalesce(f.n, 0) AS "fusedCount", coalesce(s.n, 0) AS "rerankCount"
FROM questions LEFT JOIN (SELECT q_id, count(*) AS n FROM r_vec GROUP BY ALL) v USING (q_id) LEFT JOIN (SELECT q_id, count(*) AS n FROM r_kw GROUP BY ALL) k USING (q_id)
LEFT JOIN (SELECT q_id, count(*) AS n FROM r_fused GROUP BY ALL) f USING (q_id) LEFT JOIN (SELECT q_id, count(*) AS n FROM r_scored GROUP BY ALL) s USING (q_id)""",
       ("questions", "r_vec", "r_kw", "r_fused", "r_scored"))
def _(spark, sf):
    f = t.Funnel(spark, sf)
    return retrieval.funnel_meta(f.questions, f.vector, f.keyword, f.fused, f.scored)


@query("r16_citations", f"""
SELECT r.q_id, r.rank AS citation_no, c.block_no, r.chunk_id, s.file_name, s.section_path, s.page_no, {t.sql_snippet('s.content', 80)} AS snippet
FROM r_top r JOIN store s USING (chunk_id) LEFT JOIN context c ON c.q_id = r.q_id AND c.unit_id = coalesce(s.parent_id, s.chunk_id)""", ("r_top", "store", "context"))
def _(spark, sf):
    f = t.Funnel(spark, sf)
    return retrieval.citations(f.reranked, f.context, f.chunks)


t.cte("prompts", """
SELECT q_id, '参考资料：' || chr(10) || chr(10) || coalesce(b.blocks, '') || '问题：' || question AS prompt
FROM questions LEFT JOIN (
  SELECT q_id, string_agg('[' || block_no || '] 来源: ' || file_name || CASE WHEN trim(coalesce(section_path, '')) <> '' THEN ' · ' || section_path ELSE '' END ||
         CASE WHEN page_no IS NOT NULL THEN ' · 第' || page_no || '页' ELSE '' END || chr(10) || content || chr(10) || chr(10), '' ORDER BY block_no) AS blocks
  FROM context JOIN store ON store.chunk_id = unit_id GROUP BY q_id) b USING (q_id)""", "questions", "context", "store")


def _prompts(f, history=None):
    units = f.store.select(F.col("chunk_id").alias("unit_id"), "file_name", "section_path", "page_no", "content")
    return retrieval.prompt_table(f.questions, f.context, units, history)


@query("r17_prompt_table", "SELECT q_id, prompt FROM prompts", ("prompts",))
def _(spark, sf):
    return _prompts(t.Funnel(spark, sf))


t.cte("numbered", "SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS no FROM conversations")


@query("r18_history_window", """
SELECT conv_id, turn, coalesce(string_agg(role || ': ' || text, chr(10) ORDER BY prev), '') AS history FROM (
  SELECT m.conv_id, m.turn, p.turn AS prev, p.role, substr(p.text, 1, 200) AS text
  FROM numbered m LEFT JOIN numbered p ON p.conv_id = m.conv_id AND p.no BETWEEN m.no - 6 AND m.no - 1) GROUP BY ALL""", ("numbered",))
def _(spark, sf):
    rows = retrieval.history_window(t.messages(spark, sf))
    return rows.withColumn("history", F.array_join(F.transform("history", lambda h: F.concat(h["role"], F.lit(": "), h["content"])), "\n"))


@query("r19_locate", f"""
SELECT r.q_id, r.rank, r.chunk_id, s.file_name, s.section_path, s.page_no, {t.sql_snippet('s.content', 300)} AS snippet, round(r.rerank_score, 4) AS score
FROM r_top r JOIN store s USING (chunk_id) JOIN questions q USING (q_id) WHERE trim(q.question) <> ''""", ("r_top", "store", "questions"))
def _(spark, sf):
    f = t.Funnel(spark, sf)
    return retrieval.locate(f.questions, f.reranked, f.chunks)


t.cte("last_turns", """
SELECT m.conv_id, string_agg(CASE WHEN p.role = 'user' THEN '学生' ELSE '导师' END || '：' || substr(p.text, 1, 200) || chr(10), '' ORDER BY p.no) AS before
FROM (SELECT conv_id, max(no) AS no FROM numbered GROUP BY conv_id) m JOIN numbered p ON p.conv_id = m.conv_id AND p.no BETWEEN m.no - 6 AND m.no - 1 GROUP BY m.conv_id""", "numbered")


@query("r17_prompt_with_history", """
SELECT q_id, CASE WHEN h.before IS NOT NULL THEN '之前的对话（供理解上下文，不需要重复回答）：' || chr(10) || h.before || chr(10) ELSE '' END || prompt AS prompt
FROM prompts LEFT JOIN last_turns h ON h.conv_id = q_id""", ("prompts", "last_turns"))
def _(spark, sf):
    """The question of an item continues the conversation of the same number: the messages before its last one are the history."""
    f = t.Funnel(spark, sf)
    seen = retrieval.history_window(t.messages(spark, sf))
    history = seen.groupBy(F.col("conv_id").alias("q_id")).agg(F.max_by("history", "turn").alias("history"))
    return _prompts(f, history)


@query("flagship_answer_context", """
SELECT q.q_id, r.refused, r.top_score, c.block_no, c.unit_id, c.tokens, md5(s.content) AS content_md5
FROM questions q JOIN refusals r USING (q_id) LEFT JOIN context c USING (q_id) LEFT JOIN store s ON s.chunk_id = c.unit_id""", ("questions", "refusals", "context", "store"))
def _(spark, sf):
    f = t.Funnel(spark, sf)
    texts = f.store.select(F.col("chunk_id").alias("unit_id"), F.md5(F.col("content").cast("binary")).alias("content_md5"))
    blocks = f.context.join(texts, "unit_id", "left").select("q_id", "block_no", "unit_id", "tokens", "content_md5")
    return retrieval.refuse(f.questions, f.reranked).join(blocks, "q_id", "left")


_CARD = """
SELECT c.chunk_id, c.parent_id, d.kb_id, d.file_name, md5(p.content) AS parent_md5, md5(a.content) AS prev_md5, md5(b.content) AS next_md5
FROM store c JOIN corpus d USING (doc_id) LEFT JOIN store p ON p.chunk_id = c.parent_id
LEFT JOIN store a ON a.doc_id = c.doc_id AND a.chunk_index = c.chunk_index - 1 AND a.parent_id IS NOT NULL
LEFT JOIN store b ON b.doc_id = c.doc_id AND b.chunk_index = c.chunk_index + 1 AND b.parent_id IS NOT NULL"""


def _cards(spark, sf):
    rows = t.store(spark, sf).drop("kb_id", "file_name", "status", "lang")
    return reading.chunk_context(rows, t.corpus(spark, sf).select("doc_id", "kb_id", "file_name"))


@query("k1_chunk_context", _CARD, ("store", "corpus"))
def _(spark, sf):
    def h(name, out):
        return F.md5(F.col(name).cast("binary")).alias(out)
    return _cards(spark, sf).select("chunk_id", "parent_id", "kb_id", "file_name", h("parent_content", "parent_md5"), h("prev_content", "prev_md5"), h("next_content", "next_md5"))


@query("k2_highlight_paragraphs", rf"""
SELECT chunk_id, CAST(row_number() OVER (PARTITION BY chunk_id ORDER BY n) - 1 AS INTEGER) AS pos, text,
       length(key) > 0 AND instr(regexp_replace(text, '\s+', '', 'g'), key) BETWEEN 1 AND 5 AS hit FROM (
  SELECT c.chunk_id, substr(regexp_replace(c.content, '\s+', '', 'g'), 1, 20) AS key, unnest(string_split_regex(p.content, '\n+')) AS text,
         generate_subscripts(string_split_regex(p.content, '\n+'), 1) AS n
  FROM store c JOIN store p ON p.chunk_id = c.parent_id) WHERE {t.sql_trim('text')} <> ''""", ("store",))
def _(spark, sf):
    return reading.highlight_paragraphs(_cards(spark, sf))
