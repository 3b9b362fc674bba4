"""Tables of questions against indexed chunks: two recalls, fusion, rerank, refusal, context, prompt."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from askloom.functions.arrays import rows_of
from askloom.functions.ranking import top_n
from askloom.functions.text import is_blank, segment_terms, snippet
from askloom.operators.recall import RECALL_K, SCORE_DIGITS, bm25_topk, keyword_topk, vector_topk  # noqa: F401

# ---- fixed values: funnel sizes, weights, thresholds, prompt wording ----
RRF_K = 60
FUSED_LIMIT = 30
RERANK_INPUT = 10
RERANK_KEEP = 8
REFUSE_THRESHOLD = 0.35
CONTEXT_BLOCKS = 4
CONTEXT_TOKENS = 3000
CITATION_SNIPPET = 80
DETAIL_SNIPPET = 300
HISTORY_TURNS = 6
HISTORY_CHARS = 200
HISTORY_HEADER = "之前的对话（供理解上下文，不需要重复回答）：\n"
HISTORY_STUDENT = "学生"
HISTORY_TUTOR = "导师"
CONTEXT_HEADER = "参考资料：\n\n"
QUESTION_LABEL = "问题："
# ---- end of fixed values ----


def searchable(chunks: DataFrame, documents: DataFrame, strategy: str | None = None) -> DataFrame:
    """Searchable chunks of READY documents with their ``kb_id``; the strategy filter reaches the scan."""
    ready = documents.filter(F.col("status") == "READY").select("doc_id", "kb_id", "file_name")
    found = chunks.filter(F.col("kind") == "child")
    if strategy:
        found = found.filter(F.col("strategy") == strategy)
    return found.join(ready, "doc_id")


def query_terms(questions: DataFrame, text: str = "question") -> DataFrame:
    """Distinct search terms per question (q_id, kb_id, term); a term needs a letter, a digit or a Han character."""
    terms = F.filter(F.array_distinct(segment_terms(F.col(text))), lambda t: t.rlike(r"[\p{L}\p{N}\x{4E00}-\x{10FFFF}]"))
    return rows_of(questions, terms, "q_id", "kb_id", item="term").drop("pos")


def rrf_fuse(vector: DataFrame, keyword: DataFrame, limit: int = FUSED_LIMIT, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of two recalls, scores and ranks of both kept; ties by chunk id.

    One grouping over the union of the two short lists replaces a full outer join.
    """
    def side(df: DataFrame, name: str) -> DataFrame:
        other = "fts" if name == "vector" else "vector"
        return df.select("q_id", "chunk_id", F.col("score").alias(f"{name}_score"), F.col("rank").alias(f"{name}_rank"),
                         F.lit(None).cast("double").alias(f"{other}_score"), F.lit(None).cast("int").alias(f"{other}_rank"))

    def share(rank: str) -> Column:
        return F.coalesce(F.lit(1.0) / (k + F.col(rank)), F.lit(0.0))

    both = side(vector, "vector").unionByName(side(keyword, "fts")).groupBy("q_id", "chunk_id").agg(
        *[F.max(c).alias(c) for c in ("vector_score", "vector_rank", "fts_score", "fts_rank")])
    scored = both.withColumn("rrf_score", share("vector_rank") + share("fts_rank"))
    return top_n(scored, ["q_id"], [F.desc(F.round("rrf_score", 12)), F.asc("chunk_id")], limit, "rrf_rank")


def vector_only(vector: DataFrame, limit: int = FUSED_LIMIT, k: int = RRF_K) -> DataFrame:
    """The vector recall in the shape of a fusion."""
    return vector.filter(F.col("rank") <= limit).select(
        "q_id", "chunk_id", F.col("score").alias("vector_score"), F.col("rank").alias("vector_rank"),
        F.lit(None).cast("double").alias("fts_score"), F.lit(None).cast("int").alias("fts_rank"),
        (F.lit(1.0) / (k + F.col("rank"))).alias("rrf_score"), F.col("rank").alias("rrf_rank"))


def coverage_scorer(weight: float = 8.0, bias: float = -4.0) -> Callable[[Column, Column], Column]:
    """Default pair scorer for use without a model: sigmoid of the share of question terms found in the passage."""
    def score(question: Column, passage: Column) -> Column:
        asked = F.array_distinct(segment_terms(question))
        share = F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, segment_terms(passage))) / F.size(asked)).otherwise(0.0)
        return F.round(F.lit(1.0) / (1.0 + F.exp(-(share * weight + bias))), SCORE_DIGITS)
    return score


def model_scorer(load: Callable[[], Callable[[list[str], list[str]], np.ndarray]], batch: int = 10) -> Callable[[Column, Column], Column]:
    """Hook for a cross-encoder: ``load`` runs once per task and maps questions and passages to logits.

    A failing batch gives null scores, which :func:`rerank` turns into the fusion order.
    """
    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = None
        for questions, passages in batches:
            out: list[float | None] = []
            for i in range(0, len(questions), batch):
                q, p = questions.iloc[i:i + batch].tolist(), passages.iloc[i:i + batch].tolist()
                try:
                    model = model or load()
                    out.extend((1.0 / (1.0 + np.exp(-np.asarray(model(q, p), dtype=np.float64)))).tolist())
                except Exception:  # noqa: BLE001
                    out.extend([None] * len(q))
            yield pd.Series(out, dtype="float64")
    return run


def score_pairs(fused: DataFrame, questions: DataFrame, contents: DataFrame, scorer: Callable[[Column, Column], Column],
                limit: int = RERANK_INPUT) -> DataFrame:
    """First ``limit`` candidates per question with ``rerank_score``. The texts join only these few rows; a candidate whose text is gone gets a null score."""
    few = fused.filter(F.col("rrf_rank") <= limit)
    texts = few.join(contents.select("chunk_id", "content"), "chunk_id", "left").join(questions.select("q_id", "question"), "q_id")
    return texts.withColumn("rerank_score", F.when(F.col("content").isNotNull(), scorer(F.col("question"), F.col("content")))).drop("question", "content")


def rerank(scored: DataFrame, keep: int = RERANK_KEEP) -> DataFrame:
    """Order by rerank score and keep ``keep``. A question with a missing score falls back to the fusion order."""
    failed = scored.groupBy("q_id").agg(F.bool_or(F.col("rerank_score").isNull()).alias("failed"))
    safe = scored.join(failed, "q_id").withColumn(
        "rerank_score", F.when(~F.col("failed"), F.col("rerank_score"))).drop("failed")
    return top_n(safe, ["q_id"], [F.desc_nulls_last("rerank_score"), F.asc("rrf_rank")], keep)


def keep_fused(fused: DataFrame, limit: int = RERANK_KEEP) -> DataFrame:
    """Rerank switched off: the first candidates by fusion, without a rerank score."""
    return fused.filter(F.col("rrf_rank") <= limit).withColumn("rerank_score", F.lit(None).cast("double")).withColumn(
        "rank", F.col("rrf_rank"))


def refuse(questions: DataFrame, reranked: DataFrame, threshold: float = REFUSE_THRESHOLD, null_refuses: bool = False) -> DataFrame:
    """Refuse without candidates or when the best score is below the threshold. A missing score answers in chat
    and refuses in evaluation (``null_refuses``)."""
    top = reranked.filter(F.col("rank") == 1).select("q_id", F.lit(True).alias("found"), F.col("rerank_score").alias("top_score"))
    return questions.select("q_id").join(top, "q_id", "left").withColumn(
        "refused", F.when(F.col("found").isNull(), True).when(F.col("top_score").isNull(), null_refuses)
        .otherwise(F.col("top_score") < threshold)).drop("found")


def assemble_context(reranked: DataFrame, chunks: DataFrame, parents: DataFrame, blocks: int = CONTEXT_BLOCKS,
                     budget: int = CONTEXT_TOKENS) -> DataFrame:
    """Parents of the kept chunks in order of their best child, at most ``blocks`` within ``budget`` tokens.

    chunks (chunk_id, parent_id, token_count), parents (parent_id, parent_tokens) -> (q_id, block_no, unit_id,
    is_parent, chunk_id, tokens). A block that would overflow is skipped, later ones may still fit. A missing
    parent is replaced by the best child. The fold sees the at most eight kept rows of one question.
    """
    placed = reranked.select("q_id", "chunk_id", "rank").join(chunks.select("chunk_id", "parent_id", "token_count"), "chunk_id")
    best = placed.groupBy("q_id", F.coalesce("parent_id", -F.col("chunk_id")).alias("group_id")).agg(
        F.min_by(F.struct("rank", "chunk_id", "parent_id", "token_count"), "rank").alias("c"))
    units = best.select("q_id", "c.*").join(parents.select("parent_id", "parent_tokens"), "parent_id", "left").select(
        "q_id", F.struct("rank", F.coalesce(F.when(F.col("parent_tokens").isNotNull(), F.col("parent_id")), "chunk_id").alias("unit_id"),
                         F.col("parent_tokens").isNotNull().alias("is_parent"), "chunk_id",
                         F.coalesce("parent_tokens", "token_count").cast("int").alias("tokens")).alias("u"))
    unit = "struct<rank:int,unit_id:bigint,is_parent:boolean,chunk_id:bigint,tokens:int>"
    start = F.struct(F.expr(f"cast(array() as array<{unit}>)").alias("out"), F.lit(0).alias("tokens"))

    def take(acc: Column, u: Column) -> Column:
        fits = (F.size(acc["out"]) < blocks) & (acc["tokens"] + u["tokens"] <= budget)
        return F.when(fits, F.struct(F.concat(acc["out"], F.array(u.cast(unit))).alias("out"),
                                     (acc["tokens"] + u["tokens"]).alias("tokens"))).otherwise(acc)

    chosen = units.groupBy("q_id").agg(F.array_sort(F.collect_list("u")).alias("us"))
    return rows_of(chosen, F.aggregate("us", start, take, lambda a: a["out"]), "q_id").select(
        "q_id", (F.col("pos") + 1).alias("block_no"), F.col("item.unit_id").alias("unit_id"),
        F.col("item.is_parent").alias("is_parent"), F.col("item.chunk_id").alias("chunk_id"), F.col("item.tokens").alias("tokens"))


def candidate_detail(scored: DataFrame, chunks: DataFrame) -> DataFrame:
    """(q_id, rank, candidate): one struct per scored candidate, scores to four decimals, 300-character snippet."""
    full = scored.join(chunks.select("chunk_id", "file_name", "section_path", "page_no", "content", "token_count"), "chunk_id")
    return full.select("q_id", "rank", F.struct(
        F.col("chunk_id").alias("chunkId"), F.col("file_name").alias("file"), F.col("section_path").alias("section"),
        F.col("page_no").alias("page"), snippet(F.col("content"), DETAIL_SNIPPET).alias("snippet"),
        F.col("token_count").alias("tokenCount"), *[F.round(c, 4).alias(n) for c, n in (
            ("vector_score", "vectorScore"), ("fts_score", "ftsScore"), ("rrf_score", "rrfScore"), ("rerank_score", "rerankScore"))],
        F.col("vector_rank").alias("vectorRank"), F.col("fts_rank").alias("ftsRank")).alias("candidate"))


def funnel_meta(questions: DataFrame, vector: DataFrame, keyword: DataFrame, fused: DataFrame, scored: DataFrame) -> DataFrame:
    """Rows per stage and question, zeros kept: one grouping over tagged stage rows."""
    stages = {"vectorCount": vector, "ftsCount": keyword, "fusedCount": fused, "rerankCount": scored}
    tagged = None
    for name, df in stages.items():
        part = df.select("q_id", F.lit(name).alias("stage"))
        tagged = part if tagged is None else tagged.unionByName(part)
    counts = tagged.groupBy("q_id").agg(*[F.count_if(F.col("stage") == n).alias(n) for n in stages])
    return questions.select("q_id").join(counts, "q_id", "left").fillna(0)


def citations(reranked: DataFrame, context: DataFrame, chunks: DataFrame) -> DataFrame:
    """Numbered kept chunks for the reader (1..8) next to the number of the prompt block that holds them (1..4)."""
    detail = chunks.select("chunk_id", "file_name", "section_path", "page_no", "parent_id", "content")
    blocks = context.select("q_id", F.when(F.col("is_parent"), F.col("unit_id")).otherwise(-F.col("unit_id")).alias("group_id"), "block_no")
    return (reranked.select("q_id", "chunk_id", F.col("rank").alias("citation_no")).join(detail, "chunk_id")
            .withColumn("group_id", F.coalesce("parent_id", -F.col("chunk_id")))
            .join(blocks, ["q_id", "group_id"], "left")
            .select("q_id", "citation_no", "block_no", "chunk_id", "file_name", "section_path", "page_no",
                    snippet(F.col("content"), CITATION_SNIPPET).alias("snippet")))


def locate(questions: DataFrame, reranked: DataFrame, chunks: DataFrame) -> DataFrame:
    """Where the kept chunks of every question stand: (q_id, rank, chunk_id, file_name, section_path, page_no, snippet, score). A blank question finds nothing.

    The contents join the at most eight kept rows of a question.
    """
    asked = questions.filter(~is_blank(F.col("question"))).select("q_id")
    places = chunks.select("chunk_id", "file_name", "section_path", "page_no", snippet(F.col("content"), DETAIL_SNIPPET).alias("snippet"))
    return reranked.join(asked, "q_id", "left_semi").select("q_id", "rank", "chunk_id", F.round("rerank_score", 4).alias("score")).join(places, "chunk_id")


def prompt_table(questions: DataFrame, context: DataFrame, units: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """(q_id, prompt): earlier turns, numbered blocks with their source line, the question last.

    units (unit_id, file_name, section_path, page_no, content); history (q_id, history array of struct(role, content)).
    """
    section = F.when(F.length(F.trim(F.coalesce("section_path", F.lit("")))) > 0, F.concat(F.lit(" · "), "section_path")).otherwise("")
    page = F.when(F.col("page_no").isNotNull(), F.concat(F.lit(" · 第"), F.col("page_no").cast("string"), F.lit("页"))).otherwise("")
    block = F.concat(F.lit("["), F.col("block_no").cast("string"), F.lit("] 来源: "), "file_name", section, page, F.lit("\n"),
                     "content", F.lit("\n\n"))
    blocks = (context.join(units, "unit_id").select("q_id", F.struct("block_no", block.alias("text")).alias("b"))
              .groupBy("q_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("b")), lambda b: b["text"]), "").alias("blocks")))
    asked = questions.select("q_id", "question").join(blocks, "q_id", "left")
    before = F.lit("")
    if history is not None:
        asked = asked.join(history.select("q_id", "history"), "q_id", "left")
        turns = F.transform("history", lambda h: F.concat(
            F.when(h["role"] == "user", HISTORY_STUDENT).otherwise(HISTORY_TUTOR), F.lit("："),
            F.substring(h["content"], 1, HISTORY_CHARS), F.lit("\n")))
        before = F.when(F.size("history") > 0, F.concat(F.lit(HISTORY_HEADER), F.array_join(turns, ""), F.lit("\n"))).otherwise("")
    return asked.select("q_id", F.concat(before, F.lit(CONTEXT_HEADER), F.coalesce("blocks", F.lit("")), F.lit(QUESTION_LABEL),
                                         "question").alias("prompt"))


def history_window(messages: DataFrame, turns: int = HISTORY_TURNS, chars: int = HISTORY_CHARS) -> DataFrame:
    """For every message the ``turns`` messages before it, cut to ``chars``.

    messages (conv_id, turn, role, content), ordered by ``turn`` inside a conversation. Messages are counted, not turn numbers, so gaps
    lose nothing. A conversation is read as a sorted stream with a frame of ``turns`` rows; messages that share a turn see the ones
    sorted before them and are told apart by role and content.
    """
    cut = messages.select("conv_id", "turn", "role", F.substring("content", 1, chars).alias("content"))
    before = W.partitionBy("conv_id").orderBy("turn", "role", "content").rowsBetween(-turns, -1)
    return cut.select("conv_id", "turn", F.collect_list(F.struct("role", "content")).over(before).alias("history"))
