"""Queries over evaluation sets, the ablation grid and answer verdicts."""

from __future__ import annotations

import uuid
from functools import cached_property

from pyspark.sql import functions as F

from askloom.functions import text as tx
from askloom.operators import ablation, evaluation as ev, indexing, retrieval
from askloom.plans import tables as t
from askloom.plans.registry import query
from askloom.schemas import RETRIEVED_JSON
from askloom.session import materialize, shared_dir
from askloom.sources import sinks

# ---------------------------------------------------------------- evaluation sets


def _raw_questions(spark, sf):
    """Question entries from the orders: some blank, some of unknown type, some without golds."""
    o = t.read(spark, sf, "orders")
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", "fact").when(F.col("o_orderpriority") == "2-HIGH", "Multi_Hop").when(
        F.col("o_orderpriority") == "3-MEDIUM", "TABLE").when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "no_answer").otherwise("essay")
    question = F.when(F.col("o_totalprice") < 50000, F.lit(" \n ")).otherwise(F.concat(F.lit("  order "), F.col("o_orderkey").cast("string"), F.lit("?\t")))
    golds = F.when(F.col("o_orderstatus") == "F", F.array("o_custkey")).otherwise(F.expr("cast(array() as array<bigint>)"))
    return o.select(F.col("o_orderkey").alias("q_id"), (F.length("o_orderpriority") % 5).cast("bigint").alias("kb_id"), question.alias("question"), kind.alias("type"),
                    golds.alias("gold_chunk_ids"), F.lit(None).cast("string").alias("gold_answer"))


t.cte("raw_q", """
SELECT o_orderkey AS q_id, CAST(length(o_orderpriority) % 5 AS BIGINT) AS kb_id, CASE WHEN o_totalprice < 50000 THEN '' ELSE 'order ' || o_orderkey || '?' END AS question,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'FACT' WHEN '2-HIGH' THEN 'MULTI_HOP' WHEN '3-MEDIUM' THEN 'TABLE' WHEN '4-NOT SPECIFIED' THEN 'NO_ANSWER' ELSE 'ESSAY' END AS type,
       o_orderstatus = 'F' AS has_gold FROM orders""")


@query("v1_validate_eval_questions", """
SELECT q_id, kb_id, question, type, CASE WHEN question = '' THEN 'blank' WHEN type = 'ESSAY' THEN 'type' WHEN type <> 'NO_ANSWER' AND NOT has_gold THEN 'gold' END AS reason FROM raw_q""", ("raw_q",))
def _(spark, sf):
    return ev.check_eval_questions(_raw_questions(spark, sf)).select("q_id", "kb_id", "question", "type", "reason")


@query("v2_eval_type_stats", """
SELECT kb_id, count(*) FILTER (type = 'FACT') AS fact, count(*) FILTER (type = 'MULTI_HOP') AS multi_hop, count(*) FILTER (type = 'TABLE') AS "table",
       count(*) FILTER (type = 'NO_ANSWER') AS no_answer, count(*) AS total
FROM raw_q WHERE question <> '' AND type <> 'ESSAY' AND (type = 'NO_ANSWER' OR has_gold) GROUP BY kb_id""", ("raw_q",))
def _(spark, sf):
    return ev.eval_type_stats(ev.validate_eval_questions(_raw_questions(spark, sf))[0])


def sql_gram_rows(source: str, key: str, text: str) -> str:
    return rf"""SELECT DISTINCT {key}, substr(flat, i, 10) AS gram FROM (SELECT {key}, flat, unnest(range(1, length(flat) - 8)) AS i
      FROM (SELECT {key}, regexp_replace({text}, '\s+', '', 'g') AS flat FROM {source}))"""


t.cte("doc_grams", sql_gram_rows("documents", "doc_id", "text"))
t.cte("item_grams", sql_gram_rows("benchmark", "item_id", "text"))


@query("v3_char_shingles", """
SELECT d.doc_id, coalesce(g.n, 0) AS n, g.first_gram, g.last_gram FROM documents d
LEFT JOIN (SELECT doc_id, count(*) AS n, min(gram) AS first_gram, max(gram) AS last_gram FROM doc_grams GROUP BY ALL) g USING (doc_id)""", ("doc_grams",))
def _(spark, sf):
    docs = t.spread(t.read(spark, sf, "documents").select("doc_id", "text")).select("doc_id", tx.shingles(F.col("text")).alias("g"))
    return docs.select("doc_id", F.size("g").cast("bigint").alias("n"), F.array_min("g").alias("first_gram"), F.array_max("g").alias("last_gram"))


@query("v4_shingle_coverage", """
SELECT item_id, doc_id, shared, round(shared::DOUBLE / least(a.n, b.n), 6) AS coverage
FROM (SELECT item_id, doc_id, count(*) AS shared FROM doc_grams JOIN item_grams USING (gram) GROUP BY ALL)
JOIN (SELECT item_id, count(*) AS n FROM item_grams GROUP BY ALL) a USING (item_id) JOIN (SELECT doc_id, count(*) AS n FROM doc_grams GROUP BY ALL) b USING (doc_id)
WHERE shared::DOUBLE / least(a.n, b.n) >= 0.30""", ("doc_grams", "item_grams"))
def _(spark, sf):
    pairs = ev.shingle_coverage(t.read(spark, sf, "benchmark"), t.spread(t.read(spark, sf, "documents").select("doc_id", "text")), "item_id", "doc_id")
    return pairs.withColumn("coverage", F.round("coverage", 6))


# ---------------------------------------------------------------- ablation grid
STRATEGIES = ("FIXED", "RECURSIVE", "STRUCTURE_AWARE")


class Grid:
    """Golds, candidates, hits and ranks of the six configurations; each stage is small and written once."""

    def __init__(self, spark, sf):
        rows = t.store(spark, sf, *STRATEGIES).filter((F.col("kind") == "child") & (F.col("status") == "READY"))
        asked = t.questions(spark, sf)
        searched = rows.filter(F.col("strategy") == "STRUCTURE_AWARE").select("chunk_id", F.col("content").alias("question"))
        pairs = ev.shingle_coverage(asked, searched, "q_id", "chunk_id", text="question").select("q_id", "chunk_id")
        self.golds = materialize(pairs.join(rows.select("chunk_id", "parent_id", "content"), "chunk_id"), "golds")
        counts = self.golds.groupBy("q_id").agg(F.count(F.lit(1)).alias("n"))
        kind = F.when(F.col("n").isNull(), "NO_ANSWER").when(F.col("n") == 1, "FACT").when(F.col("n") == 2, "MULTI_HOP").otherwise("TABLE")
        self.questions = asked.join(counts, "q_id", "left").withColumn("type", kind).drop("n")
        # each index is read by one recall only, so neither is written first
        indexed = rows.select("kb_id", "strategy", "chunk_id", "content")
        vectors = t.EMBEDDER(indexed, "content").drop("content")
        postings = indexing.term_counts(indexed.filter(F.col("strategy").isin(*{c[1] for c in ev.CONFIGS if c[2]})), "kb_id", "strategy", "chunk_id")
        vector, keyword = ablation.grid_recall(asked, vectors, postings, t.EMBEDDER)
        self.candidates = materialize(ablation.grid_candidates(
            materialize(vector, "grid-vector"), materialize(keyword, "grid-keyword"), asked, rows, retrieval.coverage_scorer(), materialize), "candidates")
        self.texts = rows.select("chunk_id", "parent_id", "content")

    @cached_property
    def hits(self):
        return materialize(ev.hits(self.candidates.join(self.texts, "chunk_id"), self.golds), "hits")

    @property
    def ranks(self):
        return ev.question_ranks(self.questions, self.hits)

    @property
    def refusals(self):
        return ablation.grid_refusals(self.questions, self.candidates)


_GRIDS: dict[tuple, Grid] = {}


def grid(spark, sf) -> Grid:
    key = (spark.sparkContext.applicationId, sf)
    if key not in _GRIDS:
        _GRIDS[key] = Grid(spark, sf)
    return _GRIDS[key]


t.cte("struct_ready", "SELECT chunk_id, parent_id, content FROM full_ready WHERE strategy = 'STRUCTURE_AWARE'", "full_ready")
t.cte("struct_grams", sql_gram_rows("struct_ready", "chunk_id", "content"), "struct_ready")
t.cte("golds", """
SELECT p.q_id, p.chunk_id, s.parent_id, s.content FROM (
  SELECT item_id AS q_id, chunk_id, count(*) AS shared FROM struct_grams JOIN item_grams USING (gram) GROUP BY ALL) p
JOIN (SELECT item_id AS q_id, count(*) AS n FROM item_grams GROUP BY ALL) a USING (q_id) JOIN (SELECT chunk_id, count(*) AS n FROM struct_grams GROUP BY ALL) b USING (chunk_id)
JOIN struct_ready s USING (chunk_id) WHERE p.shared::DOUBLE / least(a.n, b.n) >= 0.30""", "struct_grams", "item_grams", "struct_ready")
t.cte("eval_q", """
SELECT q_id, kb_id, question, CASE WHEN n IS NULL THEN 'NO_ANSWER' WHEN n = 1 THEN 'FACT' WHEN n = 2 THEN 'MULTI_HOP' ELSE 'TABLE' END AS type
FROM questions LEFT JOIN (SELECT q_id, count(*) AS n FROM golds GROUP BY ALL) USING (q_id)""", "questions", "golds")
t.cte("configs", "SELECT * FROM (VALUES " + ", ".join(
    f"('{n}', '{s}', {str(a).upper()}, {str(b).upper()}, {str(c).upper()})" for n, s, a, b, c in ev.CONFIGS) + ") c(config, strategy, use_fts, use_rerank, parent_credit)")
t.cte("candidates", """
SELECT config, strategy, parent_credit, q_id, rank, chunk_id, NULL::DOUBLE AS rerank_score FROM configs JOIN f_vec USING (strategy) WHERE NOT use_fts AND rank <= 8
UNION ALL SELECT config, strategy, parent_credit, q_id, rrf_rank, chunk_id, NULL FROM configs JOIN f_fused USING (strategy) WHERE use_fts AND NOT use_rerank AND rrf_rank <= 8
UNION ALL SELECT config, strategy, parent_credit, q_id, rank, chunk_id, rerank_score FROM configs JOIN f_top USING (strategy) WHERE use_rerank""".replace("UNION ALL", "UNION"), "configs", "f_vec", "f_fused", "f_top")
t.cte("cand_flat", "SELECT DISTINCT c.chunk_id, r.content FROM candidates c JOIN full_ready r USING (chunk_id) WHERE c.strategy <> 'STRUCTURE_AWARE'", "candidates", "full_ready")
t.cte("cand_grams", sql_gram_rows("cand_flat", "chunk_id", "content"), "cand_flat")
t.cte("gold_grams", sql_gram_rows("golds", "chunk_id", "content"), "golds")
t.cte("gram_pairs", """
SELECT c, g FROM (SELECT a.chunk_id AS c, b.chunk_id AS g, count(*) AS n FROM cand_grams a JOIN gold_grams b USING (gram) GROUP BY ALL)
JOIN (SELECT chunk_id AS c, count(*) AS cn FROM cand_grams GROUP BY ALL) USING (c) JOIN (SELECT chunk_id AS g, count(*) AS gn FROM gold_grams GROUP BY ALL) USING (g)
WHERE n::DOUBLE / least(cn, gn) >= 0.30""", "cand_grams", "gold_grams")
t.cte("hit_rows", """
SELECT c.config, c.q_id, c.rank FROM candidates c JOIN golds g ON g.q_id = c.q_id AND g.chunk_id = c.chunk_id
UNION SELECT c.config, c.q_id, c.rank FROM candidates c JOIN full_ready r USING (chunk_id) WHERE c.parent_credit AND r.parent_id IN (SELECT parent_id FROM golds)
UNION SELECT c.config, c.q_id, c.rank FROM candidates c JOIN gram_pairs p ON p.c = c.chunk_id JOIN golds g ON g.q_id = c.q_id AND g.chunk_id = p.g WHERE c.strategy <> 'STRUCTURE_AWARE'""",
      "candidates", "golds", "gram_pairs", "full_ready")
t.cte("ranks", """
SELECT c.config, q.q_id, q.type, h.hit_rank FROM configs c CROSS JOIN eval_q q
LEFT JOIN (SELECT config, q_id, min(rank) AS hit_rank FROM hit_rows WHERE rank <= 5 GROUP BY ALL) h ON h.config = c.config AND h.q_id = q.q_id WHERE q.type <> 'NO_ANSWER'""", "configs", "eval_q", "hit_rows")
t.cte("grid_refusals", """
SELECT c.config, c.use_rerank, q.q_id, q.type, coalesce(x.rerank_score < 0.35, TRUE) AS refused FROM configs c CROSS JOIN eval_q q
LEFT JOIN (SELECT * FROM candidates WHERE rank = 1) x ON x.config = c.config AND x.q_id = q.q_id""", "configs", "eval_q", "candidates")


@query("v5_is_hit", "SELECT config, q_id, rank FROM hit_rows", ("hit_rows",))
def _(spark, sf):
    return grid(spark, sf).hits


@query("v6_hit_rate_mrr", """
SELECT config, round(avg(CASE WHEN hit_rank IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS hit_rate_at5, round(avg(coalesce(1.0::DOUBLE / hit_rank, 0)), 6) AS mrr, count(*) AS questions
FROM ranks GROUP BY config""", ("ranks",))
def _(spark, sf):
    return ev.hit_rate_mrr(grid(spark, sf).ranks).withColumns({"hit_rate_at5": F.round("hit_rate_at5", 6), "mrr": F.round("mrr", 6)})


@query("v7_hit_rate_by_type", """
SELECT config, type, round(avg(CASE WHEN hit_rank IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END), 4) AS hit_rate, count(*) AS total FROM ranks GROUP BY GROUPING SETS ((config, type), (config))""", ("ranks",))
def _(spark, sf):
    return ev.hit_rate_by_type(grid(spark, sf).ranks)


@query("v8_refusal_rate", """
SELECT config, round(avg(CASE WHEN refused AND use_rerank THEN 1.0::DOUBLE ELSE 0 END), 4) AS refusal_rate, count(*) AS no_answer_total
FROM grid_refusals WHERE type = 'NO_ANSWER' GROUP BY config""", ("grid_refusals",))
def _(spark, sf):
    g = grid(spark, sf)
    return ev.refusal_rate(g.questions, g.refusals)


def _metrics(spark, sf):
    g = grid(spark, sf)
    return ev.hit_rate_mrr(g.ranks).join(ev.refusal_rate(g.questions, g.refusals), "config", "left")


_METRICS = """
SELECT r.config, CAST(CAST(avg(CASE WHEN hit_rank IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END) AS DECIMAL(5,4)) AS VARCHAR) AS hit_rate_at5,
       CAST(CAST(avg(coalesce(1.0::DOUBLE / hit_rank, 0)) AS DECIMAL(5,4)) AS VARCHAR) AS mrr, count(*) AS questions, any_value(f.refusal_rate) AS refusal_rate
FROM ranks r LEFT JOIN (SELECT config, round(avg(CASE WHEN refused AND use_rerank THEN 1.0::DOUBLE ELSE 0 END), 4) AS refusal_rate FROM grid_refusals WHERE type = 'NO_ANSWER' GROUP BY config) f USING (config)
GROUP BY r.config"""


@query("v9_ablation_grid", _METRICS, ("ranks", "grid_refusals"))
def _(spark, sf):
    return _metrics(spark, sf).select("config", *[F.col(c).cast("decimal(5,4)").cast("string").alias(c) for c in ("hit_rate_at5", "mrr")], "questions", "refusal_rate")


def _run_at():
    return F.timestamp_seconds(F.lit(1700000000))


def _stored_runs(spark, sf):
    """The grid's runs, written as the product keeps them."""
    path = f"{shared_dir(spark)}/askloom/{spark.sparkContext.applicationId}/eval_run-{uuid.uuid4().hex}"
    g = grid(spark, sf)
    runs = sinks.eval_run_rows(_metrics(spark, sf), ev.ablation_configs(spark), ev.hit_rate_by_type(g.ranks), g.ranks, 1, _run_at())
    sinks.append_eval_runs(runs, path)
    return spark.read.parquet(path)


t.cte("stored_types", """
SELECT config, string_agg(type || '=' || n || '/' || hit_rate, ' ' ORDER BY type) AS types FROM (
  SELECT config, type, count(*) AS n, round(avg(CASE WHEN hit_rank IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END), 4) AS hit_rate FROM ranks GROUP BY config, type) GROUP BY config""", "ranks")


@query("s6_append_eval_run", f"""
SELECT CAST(1 AS BIGINT) AS kb_id, m.config AS name, c.strategy, c.use_fts, c.use_rerank, c.parent_credit, m.hit_rate_at5, m.mrr, m.refusal_rate, t.types,
       (SELECT string_agg(q_id || ':' || coalesce(hit_rank, 0), ',' ORDER BY q_id) FROM ranks r WHERE r.config = m.config) AS questions
FROM ({_METRICS}) m JOIN configs c ON c.config = m.config JOIN stored_types t ON t.config = m.config""", ("ranks", "grid_refusals", "configs", "stored_types"))
def _(spark, sf):
    config = F.from_json("config", "strategy string, useFts boolean, useRerank boolean, parentCredit boolean")
    detail = F.from_json("detail", "byType map<string, struct<hitRate:double,total:bigint>>, refusalRate double, questions array<struct<id:bigint,type:string,rank:int>>")
    runs = _stored_runs(spark, sf).withColumns({"c": config, "d": detail})
    types = F.array_join(F.transform(F.array_sort(F.map_keys("d.byType")), lambda k: F.concat(
        k, F.lit("="), F.element_at("d.byType", k)["total"].cast("string"), F.lit("/"), F.element_at("d.byType", k)["hitRate"].cast("string"))), " ")
    questions = F.array_join(F.transform("d.questions", lambda q: F.concat_ws(":", q["id"].cast("string"), F.coalesce(q["rank"], F.lit(0)).cast("string"))), ",")
    return runs.select("kb_id", "name", "c.strategy", F.col("c.useFts").alias("use_fts"), F.col("c.useRerank").alias("use_rerank"), F.col("c.parentCredit").alias("parent_credit"),
                       F.col("hit_rate_at5").cast("string").alias("hit_rate_at5"), F.col("mrr").cast("string").alias("mrr"), F.col("d.refusalRate").alias("refusal_rate"),
                       types.alias("types"), questions.alias("questions"))


@query("v14_latest_runs_stored", "SELECT CAST(1 AS BIGINT) AS kb_id, config AS name FROM configs", ("configs",))
def _(spark, sf):
    return ev.latest_runs(_stored_runs(spark, sf).drop("name")).select("kb_id", "name")


# ---------------------------------------------------------------- answers and verdicts


def _verdicts(spark, sf):
    """Answers and verdicts: an assistant message is an answer citing as many blocks as it has lines; the label of
    the document with the conversation's number is the judge's word, and a missing label is a broken verdict."""
    m = t.read(spark, sf, "conversations").filter(F.col("role") == "assistant")
    labels = t.read(spark, sf, "labels").withColumnRenamed("doc_id", "conv_id")
    n = F.size(F.split("text", "\n", -1))
    marks = F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("["), i.cast("string"), F.lit("]"))), "")
    good = F.to_json(F.struct((F.col("quality") == 1).alias("faithful"), F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(
        i.alias("no"), ((i % 2 == 1) | (F.col("quality") == 1)).alias("supports"))).alias("citations")))
    return m.join(labels, "conv_id", "left").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("q_id"), "conv_id", F.concat("text", marks).alias("answer"),
        F.when(F.col("quality").isNotNull(), good).otherwise("not json").alias("verdict"))


t.cte("verdicts", r"""
SELECT conv_id * 1000 + turn AS q_id, conv_id, n + regexp_matches_n AS used, quality,
       CASE WHEN quality IS NULL THEN 0 WHEN quality = 1 THEN n ELSE (n + 1) // 2 END AS supported, coalesce(quality = 1, FALSE) AS faithful
FROM (SELECT *, len(string_split(text, chr(10))) AS n, len(regexp_extract_all(text, '\[(\d+)\]')) AS regexp_matches_n FROM conversations WHERE role = 'assistant') c
LEFT JOIN labels l ON l.doc_id = c.conv_id""")


@query("v10_extract_citations", r"""
SELECT conv_id * 1000 + turn AS q_id, array_to_string(list_transform(range(1, len(string_split(text, chr(10))) + 1), lambda i: CAST(i AS VARCHAR)), ',') AS citations,
       CAST(len(string_split(text, chr(10))) AS INTEGER) AS citation_count FROM conversations WHERE role = 'assistant'""")
def _(spark, sf):
    return ev.extract_citations(_verdicts(spark, sf)).select("q_id", F.array_join(F.col("citations").cast("array<string>"), ",").alias("citations"), "citation_count")


@query("v11_citation_accuracy", "SELECT CAST(sum(supported) AS BIGINT) AS supported, CAST(sum(used) AS BIGINT) AS used, round(sum(supported)::DOUBLE / sum(used), 6) AS citation_accuracy FROM verdicts", ("verdicts",))
def _(spark, sf):
    return ev.citation_accuracy(_verdicts(spark, sf)).withColumn("citation_accuracy", F.round("citation_accuracy", 6))


@query("v12_faithfulness", """
SELECT c.kb_id, round(avg(CASE WHEN v.faithful THEN 1.0::DOUBLE ELSE 0 END), 6) AS faithfulness, count(*) AS answerable FROM (
  SELECT conv_id * 1000 + turn + 1 AS q_id, CAST(turn AS BIGINT) AS kb_id FROM conversations WHERE role = 'user') c LEFT JOIN verdicts v USING (q_id) GROUP BY c.kb_id""", ("verdicts",))
def _(spark, sf):
    asked = t.read(spark, sf, "conversations").filter(F.col("role") == "user").select(
        (F.col("conv_id") * 1000 + F.col("turn") + 1).alias("q_id"), F.col("turn").alias("kb_id"), F.lit("FACT").alias("type"))
    return ev.faithfulness(asked, _verdicts(spark, sf)).withColumn("faithfulness", F.round("faithfulness", 6))


@query("v13_calibrate_threshold", """
SELECT kb_id, 0.35::DOUBLE AS current_threshold, floor((CASE WHEN lo < 0 OR hi < 0 THEN 0.35::DOUBLE ELSE (lo + hi) / 2 END) * 1000 + 0.5) / 1000 AS suggested_threshold,
       floor(lo * 1000 + 0.5) / 1000 AS min_answerable, floor(hi * 1000 + 0.5) / 1000 AS max_no_answer FROM (
  SELECT q.kb_id, coalesce(min(x.rerank_score) FILTER (q.type <> 'NO_ANSWER'), -1.0) AS lo, coalesce(max(x.rerank_score) FILTER (q.type = 'NO_ANSWER'), -1.0) AS hi
  FROM eval_q q JOIN (SELECT * FROM candidates WHERE rank = 1 AND rerank_score IS NOT NULL) x USING (q_id) GROUP BY q.kb_id)""", ("eval_q", "candidates"))
def _(spark, sf):
    g = grid(spark, sf)
    top = g.candidates.filter((F.col("rank") == 1) & F.col("use_rerank") & F.col("rerank_score").isNotNull()).select("q_id", F.col("rerank_score").alias("top_score"))
    return ev.calibrate_threshold(g.questions.join(top, "q_id"))


@query("v14_latest_runs", """
SELECT id, kb_id, name FROM (SELECT o_orderkey AS id, CAST(length(o_orderpriority) AS BIGINT) AS kb_id, o_orderstatus || ' ' || o_orderpriority AS name,
       row_number() OVER (PARTITION BY length(o_orderpriority) ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn <= 30""")
def _(spark, sf):
    runs = t.read(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.length("o_orderpriority").cast("bigint").alias("kb_id"), F.col("o_orderdate").alias("created_at"),
        F.to_json(F.struct(F.concat_ws(" ", "o_orderstatus", "o_orderpriority").alias("name"))).alias("config"))
    return ev.latest_runs(runs).select("id", "kb_id", "name")


# ---------------------------------------------------------------- stored answer evaluations and the query log


@query("s6_append_generation_run", """
SELECT c.kb_id, 'generation' AS name, CAST(CAST(f.faithfulness AS DECIMAL(5,4)) AS VARCHAR) AS faithfulness, CAST(CAST(a.accuracy AS DECIMAL(5,4)) AS VARCHAR) AS citation_accuracy, f.answerable, a.used AS citations
FROM (SELECT DISTINCT CAST(turn AS BIGINT) AS kb_id FROM conversations WHERE role = 'user') c
JOIN (SELECT CAST(m.turn AS BIGINT) AS kb_id, avg(CASE WHEN v.faithful THEN 1.0::DOUBLE ELSE 0 END) AS faithfulness, count(*) AS answerable FROM conversations m
      LEFT JOIN verdicts v ON v.q_id = m.conv_id * 1000 + m.turn + 1 WHERE m.role = 'user' GROUP BY m.turn) f USING (kb_id),
  (SELECT sum(supported)::DOUBLE / sum(used) AS accuracy, CAST(sum(used) AS BIGINT) AS used FROM verdicts) a""", ("verdicts",))
def _(spark, sf):
    asked = t.read(spark, sf, "conversations").filter(F.col("role") == "user").select(
        (F.col("conv_id") * 1000 + F.col("turn") + 1).alias("q_id"), F.col("turn").alias("kb_id"), F.lit("FACT").alias("type"))
    verdicts = _verdicts(spark, sf)
    calibration = ev.calibrate_threshold(asked.withColumn("top_score", F.lit(0.5)))
    path = f"{shared_dir(spark)}/askloom/{spark.sparkContext.applicationId}/eval_run-{uuid.uuid4().hex}"
    sinks.append_eval_runs(sinks.generation_run_rows(ev.faithfulness(asked, verdicts), ev.citation_accuracy(verdicts), calibration, "generation", _run_at()), path)
    detail = F.from_json("detail", "citationTotal bigint, answerable bigint")
    return ev.latest_runs(spark.read.parquet(path).drop("name")).withColumn("d", detail).select(
        "kb_id", "name", F.col("faithfulness").cast("string").alias("faithfulness"), F.col("citation_accuracy").cast("string").alias("citation_accuracy"),
        F.col("d.answerable").alias("answerable"), F.col("d.citationTotal").alias("citations"))


_HAN_APART = r"regexp_replace(p.prompt, '[\x{4E00}-\x{9FFF}]', ' a ', 'g')"


@query("s5_append_query_log", f"""
SELECT q.q_id AS id, q.kb_id, 'v' || q.q_id % 7 AS visitor_id, q.question, coalesce(c.chosen, '') AS chosen, coalesce(s.n, 0) AS candidates, coalesce(s.top_chunk, -1) AS top_chunk,
       CASE WHEN NOT r.refused THEN upper(substr(q.question, 1, 40)) END AS answer, CASE WHEN NOT r.refused THEN CAST(length(p.prompt) * 3 AS INTEGER) END AS latency_ms,
       CASE WHEN NOT r.refused THEN CAST({t.sql_tokens(_HAN_APART)} AS INTEGER) END AS prompt_tokens,
       CASE WHEN NOT r.refused THEN CAST({t.sql_tokens("upper(substr(q.question, 1, 40))")} AS INTEGER) END AS completion_tokens,
       CASE WHEN NOT r.refused THEN 1700000000 + q.q_id END AS written_at
FROM questions q JOIN prompts p USING (q_id) JOIN refusals r USING (q_id)
LEFT JOIN (SELECT q_id, string_agg(CAST(unit_id AS VARCHAR), ',' ORDER BY block_no) AS chosen FROM context GROUP BY ALL) c USING (q_id)
LEFT JOIN (SELECT q_id, count(*) AS n, arg_min(chunk_id, rrf_rank) AS top_chunk FROM r_scored GROUP BY ALL) s USING (q_id)""".replace("'v' || q.q_id % 7 AS visitor_id", "CASE WHEN NOT r.refused THEN 'v' || (q.q_id % 7) END AS visitor_id"),
       ("questions", "context", "r_scored", "prompts", "refusals"))
def _(spark, sf):
    f = t.Funnel(spark, sf)
    detail = retrieval.candidate_detail(f.scored.withColumn("rank", F.col("rrf_rank")), f.chunks)
    units = f.store.select(F.col("chunk_id").alias("unit_id"), "file_name", "section_path", "page_no", "content")
    answered = retrieval.refuse(f.questions, f.reranked).filter("not refused").select("q_id")
    answer = F.upper(F.substring("question", 1, 40))
    answers = retrieval.prompt_table(f.questions, f.context, units).join(answered, "q_id", "left_semi").join(f.questions.select("q_id", "question"), "q_id").select(
        "q_id", F.concat(F.lit("v"), (F.col("q_id") % 7).cast("string")).alias("visitor_id"), answer.alias("answer"), (F.length("prompt") * 3).alias("latency_ms"),
        tx.count_tokens(F.col("prompt")).alias("prompt_tokens"), tx.count_tokens(answer).alias("completion_tokens"), F.timestamp_seconds(F.lit(1700000000) + F.col("q_id")).alias("created_at"))
    rows = sinks.query_log_rows(f.questions, detail, f.context, retrieval.funnel_meta(f.questions, f.vector, f.keyword, f.fused, f.scored), answers)
    path = f"{shared_dir(spark)}/askloom/{spark.sparkContext.applicationId}/query_log-{uuid.uuid4().hex}"
    failed = sinks.append_query_log(rows, path)
    if failed:
        raise RuntimeError(failed)
    got = F.from_json("retrieved", RETRIEVED_JSON)
    return spark.read.parquet(path).select(
        "id", "kb_id", "visitor_id", "question", F.array_join(F.col("chosen_ids").cast("array<string>"), ",").alias("chosen"), F.size(got).cast("bigint").alias("candidates"),
        F.coalesce(F.get(got, F.lit(0))["chunkId"], F.lit(-1)).alias("top_chunk"), "answer", "latency_ms", "prompt_tokens", "completion_tokens",
        F.unix_seconds("created_at").alias("written_at"))
