"""Evaluation of retrieval configurations and of answers, over tables of questions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askloom.functions.arrays import rows_of
from askloom.functions.ranking import bloom_filter, broadcast_limit, estimated_bytes, might_hold, salted_join, top_n
from askloom.functions.text import SHINGLE, citation_numbers, is_blank, trim_controls
from askloom.schemas import QUESTION_TYPES, VERDICT_JSON

# ---- fixed values: thresholds and the six configurations ----
TOP_K = 5
MIN_COVERAGE = 0.30
REFUSE_THRESHOLD = 0.35
CONFIGS = (
    ("① 固定长度+纯向量", "FIXED", False, False, False),
    ("② 递归分隔符+纯向量", "RECURSIVE", False, False, False),
    ("③ 结构感知+纯向量", "STRUCTURE_AWARE", False, False, False),
    ("④ 结构感知+父子分块", "STRUCTURE_AWARE", False, False, True),
    ("⑤ 结构感知+双路召回+RRF", "STRUCTURE_AWARE", True, False, False),
    ("⑥ ⑤+Rerank 精排", "STRUCTURE_AWARE", True, True, False),
)
# ---- end of fixed values ----

GRAM_GROWTH = 256  # bytes of shingle rows per stored byte of text
GRAMS_AT_ONCE = 1 << 18
"""Characters of texts that are hashed side by side."""
GOLD_TILE = 128
"""Golds of one question whose texts meet its candidates at once."""
CANDIDATE_GROUP = 64
"""Candidates of one question that a gold is compared with at once."""


def ablation_configs(spark: SparkSession) -> DataFrame:
    """The six configurations: name, strategy, use_fts, use_rerank, parent_credit."""
    return spark.createDataFrame(list(CONFIGS), "config string, strategy string, use_fts boolean, use_rerank boolean, parent_credit boolean")


def check_eval_questions(raw: DataFrame) -> DataFrame:
    """Trimmed questions with ``reason`` (null = valid): blank question, unknown type, or golds missing."""
    kind = F.upper(F.coalesce("type", F.lit("")))
    golds = F.coalesce(F.size("gold_chunk_ids"), F.lit(0))
    return (raw.withColumn("type", kind)
            .withColumn("reason", F.when(is_blank(F.col("question")), "blank").when(~kind.isin(*QUESTION_TYPES), "type")
                        .when((kind != "NO_ANSWER") & (golds < 1), "gold"))
            .withColumn("question", trim_controls(F.col("question")))
            .withColumn("gold_answer", trim_controls(F.coalesce("gold_answer", F.lit("")))))


def validate_eval_questions(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    checked = check_eval_questions(raw)
    return checked.filter(F.col("reason").isNull()).drop("reason"), checked.filter(F.col("reason").isNotNull())


def eval_type_stats(questions: DataFrame) -> DataFrame:
    """Questions per type and knowledge base, zeros kept, and the total."""
    return questions.groupBy("kb_id").agg(
        *[F.count_if(F.col("type") == t).alias(t.lower()) for t in QUESTION_TYPES], F.count(F.lit(1)).alias("total"))


def shingle_coverage(left: DataFrame, right: DataFrame, left_id: str, right_id: str, text: str = "text",
                     minimum: float = MIN_COVERAGE, n: int = SHINGLE, salts: int = 16) -> DataFrame:
    """Pairs whose shared shingles cover at least ``minimum`` of the smaller set: (left_id, right_id, shared, coverage).

    ``left`` is the short side (questions). Shingles are 64-bit hashes. An equi-join on them finds the pairs and the counting is partial before its shuffle. Where the
    questions' shingles are too many to broadcast, a Bloom filter of them drops the other shingles of ``right`` before these are shuffled, and frequent
    shingles are salted by the right document.
    """
    l_rows = rows_of(_hashed_grams(left, left_id, text, "l_size", n), "grams", left_id, "l_size", item="gram").drop("pos")
    r_rows = rows_of(_hashed_grams(right, right_id, text, "r_size", n), "grams", right_id, "r_size", item="gram").drop("pos")
    if estimated_bytes(l_rows) * GRAM_GROWTH > broadcast_limit(left):
        r_rows = r_rows.filter(might_hold(bloom_filter(l_rows, F.col("gram")), F.col("gram")))
    shared = (salted_join(r_rows, l_rows, ["gram"], F.col(right_id), GRAM_GROWTH, salts)
              .groupBy(left_id, right_id, "l_size", "r_size").agg(F.count(F.lit(1)).alias("shared")))
    cover = F.col("shared") / F.least("l_size", "r_size")
    return shared.withColumn("coverage", cover).filter(F.col("coverage") >= minimum).select(left_id, right_id, "shared", "coverage")


def _gram_hashes(text: str, n: int = SHINGLE) -> np.ndarray:
    """Different hashes of all runs of ``n`` characters of a text without white space."""
    return np.unique(_hash_runs(text, n))


def _hash_runs(text: str, n: int) -> np.ndarray:
    """The hash of the run of ``n`` characters that begins at each character."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(codes) < n:
        return np.zeros(0, np.uint64)
    h = np.full(len(codes) - n + 1, n, np.uint64)
    for j in range(n):
        h = (h + codes[j:len(h) + j] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return h


def _hashed_grams(df: DataFrame, key: str, text: str, size: str, n: int) -> DataFrame:
    """(key, size, grams): the different hashes of all runs of ``n`` characters of a text without its white space, and their number."""
    def rows(keys: pa.Array, found: list[np.ndarray]) -> pa.RecordBatch:
        sizes = [len(g) for g in found]
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]).astype(np.int32)), pa.array(np.concatenate(found).view(np.int64)))
        return pa.RecordBatch.from_arrays([keys, pa.array(sizes, pa.int32()), lists], names=[key, size, "grams"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin = 0
            texts = batch.column(1).to_pylist()
            while begin < len(texts):
                # texts are hashed side by side; a run over the end of a text belongs to none
                end, total = begin, 0
                while end < len(texts) and (end == begin or total + len(texts[end]) <= GRAMS_AT_ONCE):
                    total += len(texts[end])
                    end += 1
                hashes = _hash_runs("".join(texts[begin:end]), n)
                stops = np.cumsum([0, *map(len, texts[begin:end])])
                found = [np.unique(hashes[a:max(a, b - n + 1)]) for a, b in zip(stops[:-1].tolist(), stops[1:].tolist(), strict=True)]
                yield rows(batch.column(0).slice(begin, end - begin), found)
                begin = end

    flat = df.select(key, F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", "").alias("_flat"))
    schema = T.StructType([df.schema[key], T.StructField(size, T.IntegerType()), T.StructField("grams", T.ArrayType(T.LongType()))])
    return flat.mapInArrow(run, schema)


def _covering(minimum: float):
    """Batches of (q_id, ids, texts, golds): (q_id, chunk_id) of the candidates whose shingles some gold shares enough of."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                ids, texts, golds = (batch.column(c)[i].values for c in ("ids", "texts", "golds"))
                golds = [_gram_hashes(g) for g in golds.to_pylist()]
                found = np.zeros(len(ids), bool)
                for at in range(0, len(ids), CANDIDATE_GROUP):
                    grams = [_gram_hashes(t) for t in texts.slice(at, CANDIDATE_GROUP).to_pylist()]
                    sizes = np.array([len(g) for g in grams])
                    known, place = np.unique(np.concatenate(grams), return_inverse=True)
                    if not len(known):
                        continue
                    holds = np.zeros((len(known), len(grams)), bool)
                    holds[place, np.repeat(np.arange(len(grams)), sizes)] = True
                    for g in golds:
                        spot = np.minimum(np.searchsorted(known, g), len(known) - 1)
                        shared = holds[spot[known[spot] == g]].sum(axis=0)
                        small = np.minimum(sizes, len(g))
                        found[at:at + len(grams)] |= shared / np.maximum(small, 1) >= minimum
                        if found[at:at + len(grams)].all():
                            break
                if found.any():
                    q_id = batch.column("q_id").slice(i, 1)
                    yield pa.RecordBatch.from_arrays([q_id.take(pa.array(np.zeros(int(found.sum()), np.int64))), ids.filter(pa.array(found))], ["q_id", "chunk_id"])
    return run


def _covered(flat: DataFrame, golds: DataFrame, minimum: float) -> DataFrame:
    """(q_id, chunk_id) of the candidates that share enough text with a gold of their question.

    A question's few candidates lie side by side in one row and meet its golds in tiles of about ``GOLD_TILE``, so each text is cut to shingles once per tile or
    less, pairs never become rows, and a question with many golds is many tiles.
    """
    def bare(c: str) -> Column:
        return F.regexp_replace(F.coalesce(F.min(c), F.lit("")), r"\s+", "")

    texts = flat.groupBy("chunk_id").agg(bare("content").alias("text"))
    asked = flat.select("q_id", "chunk_id").distinct().join(texts, "chunk_id").filter("q_id is not null").groupBy("q_id").agg(
        F.collect_list(F.struct("chunk_id", "text")).alias("c")).select("q_id", F.col("c.chunk_id").alias("ids"), F.col("c.text").alias("texts"))
    gold_texts = golds.groupBy(F.col("chunk_id").alias("gold_id")).agg(bare("content").alias("gold"))
    gold_rows = golds.select("q_id", F.col("chunk_id").alias("gold_id")).distinct()
    number = gold_rows.groupBy("q_id").agg(F.ceil(F.count(F.lit(1)) / GOLD_TILE).cast("int").alias("n"))
    tiles = gold_rows.join(number, "q_id").withColumn("tile", F.pmod(F.xxhash64("gold_id"), "n").cast("int")).join(gold_texts, "gold_id").groupBy(
        "q_id", "tile").agg(F.collect_list("gold").alias("golds"))
    rows = salted_join(tiles, asked, ["q_id"], F.col("tile")).select("q_id", "ids", "texts", "golds")
    schema = T.StructType([flat.schema["q_id"], flat.schema["chunk_id"]])
    return rows.mapInArrow(_covering(minimum), schema).distinct()


def hits(candidates: DataFrame, golds: DataFrame, credit_scope: str = "all", minimum: float = MIN_COVERAGE) -> DataFrame:
    """Candidates that hit: (config, q_id, rank).

    candidates (config, strategy, parent_credit, q_id, rank, chunk_id, parent_id, content), golds (q_id, chunk_id,
    parent_id, content). A hit is the gold itself; with parent credit a shared parent; for flat strategies enough
    shared text with a gold of the question. ``credit_scope='all'`` credits parents of all questions' golds,
    ``'question'`` only those of the question at hand.
    """
    out = ["config", "q_id", "rank"]
    same = candidates.join(golds.select("q_id", "chunk_id").distinct(), ["q_id", "chunk_id"], "left_semi").select(*out)
    parent_keys = ["parent_id"] if credit_scope == "all" else ["q_id", "parent_id"]
    parents = golds.filter(F.col("parent_id").isNotNull()).select(*parent_keys).distinct()
    credited = candidates.filter((F.col("strategy") == "STRUCTURE_AWARE") & F.col("parent_credit")).join(
        parents, parent_keys, "left_semi").select(*out)
    flat = candidates.filter(F.col("strategy") != "STRUCTURE_AWARE")
    covered = flat.join(_covered(flat, golds, minimum), ["q_id", "chunk_id"], "left_semi").select(*out)
    return same.unionByName(credited).unionByName(covered).distinct()


def question_ranks(questions: DataFrame, hit_rows: DataFrame, names: Sequence[str] = tuple(c[0] for c in CONFIGS),
                   k: int = TOP_K) -> DataFrame:
    """(config, q_id, type, hit_rank) for every answerable question and configuration; null without a hit in ``k``.

    The handful of configurations is expanded inside each question's row.
    """
    asked = questions.filter(F.col("type") != "NO_ANSWER").select(
        "q_id", "type", F.explode(F.array(*[F.lit(n) for n in names])).alias("config"))
    first = hit_rows.filter(F.col("rank") <= k).groupBy("config", "q_id").agg(F.min("rank").alias("hit_rank"))
    return asked.join(first, ["config", "q_id"], "left")


def hit_rate_mrr(ranks: DataFrame) -> DataFrame:
    """HitRate@k and mean reciprocal rank per configuration over all answerable questions."""
    return ranks.groupBy("config").agg(
        F.avg(F.col("hit_rank").isNotNull().cast("double")).alias("hit_rate_at5"),
        F.avg(F.coalesce(F.lit(1.0) / F.col("hit_rank"), F.lit(0.0))).alias("mrr"), F.count(F.lit(1)).alias("questions"))


def hit_rate_by_type(ranks: DataFrame) -> DataFrame:
    """Hit rate per question type, four decimals; the row without a type is the configuration's total."""
    return ranks.rollup("config", "type").agg(
        F.round(F.avg(F.col("hit_rank").isNotNull().cast("double")), 4).alias("hit_rate"),
        F.count(F.lit(1)).alias("total")).filter(F.col("config").isNotNull())


def refusal_rate(questions: DataFrame, refusals: DataFrame) -> DataFrame:
    """Refused share of the NO_ANSWER questions per configuration, 0 where reranking is off.

    refusals (config, use_rerank, q_id, refused) with a row per configuration and question.
    """
    unanswerable = questions.filter(F.col("type") == "NO_ANSWER").select("q_id")
    rate = F.avg((F.col("refused") & F.col("use_rerank")).cast("double"))
    return refusals.join(unanswerable, "q_id", "left_semi").groupBy("config").agg(
        F.round(rate, 4).alias("refusal_rate"), F.count(F.lit(1)).alias("no_answer_total"))


def extract_citations(answers: DataFrame, answer: str = "answer") -> DataFrame:
    numbers = citation_numbers(F.col(answer))
    return answers.withColumn("citations", numbers).withColumn("citation_count", F.size("citations"))


def judged(verdicts: DataFrame) -> DataFrame:
    """Verdicts (q_id, answer, verdict JSON) with citations used and supported; a broken verdict supports nothing."""
    v = F.from_json("verdict", VERDICT_JSON)
    return extract_citations(verdicts).withColumn("v", v).select(
        "q_id", F.col("citation_count").alias("used"),
        F.coalesce(F.size(F.filter("v.citations", lambda c: F.coalesce(c["supports"], F.lit(False)))), F.lit(0)).alias("supported"),
        F.coalesce("v.faithful", F.lit(False)).alias("faithful"))


def citation_accuracy(verdicts: DataFrame) -> DataFrame:
    """Supported over used citations of all answers, 0 when none is used."""
    total = judged(verdicts).agg(F.coalesce(F.sum("supported"), F.lit(0)).alias("supported"), F.coalesce(F.sum("used"), F.lit(0)).alias("used"))
    return total.withColumn("citation_accuracy", F.when(F.col("used") > 0, F.col("supported") / F.col("used")).otherwise(0.0))


def faithfulness(questions: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Faithful share of all answerable questions; refused and failed ones stay in the denominator."""
    asked = questions.filter(F.col("type") != "NO_ANSWER").select("kb_id", "q_id")
    return asked.join(judged(verdicts).select("q_id", "faithful"), "q_id", "left").groupBy("kb_id").agg(
        F.avg(F.coalesce("faithful", F.lit(False)).cast("double")).alias("faithfulness"), F.count(F.lit(1)).alias("answerable"))


def _half_up(c: Column, digits: int) -> Column:
    return F.floor(c * 10 ** digits + 0.5) / 10 ** digits


def calibrate_threshold(top_scores: DataFrame, current: float = REFUSE_THRESHOLD) -> DataFrame:
    """Per knowledge base: lowest top score of answerable and highest of unanswerable questions and their middle.

    top_scores (kb_id, type, top_score). -1 marks a missing side; then the current threshold stays.
    """
    answerable = F.col("type") != "NO_ANSWER"
    both = top_scores.groupBy("kb_id").agg(
        F.coalesce(F.min(F.when(answerable, F.col("top_score"))), F.lit(-1.0)).alias("lo"),
        F.coalesce(F.max(F.when(~answerable, F.col("top_score"))), F.lit(-1.0)).alias("hi"))
    middle = F.when((F.col("lo") < 0) | (F.col("hi") < 0), F.lit(current)).otherwise((F.col("lo") + F.col("hi")) / 2)
    return both.select("kb_id", F.lit(current).alias("current_threshold"), _half_up(middle, 3).alias("suggested_threshold"),
                       _half_up(F.col("lo"), 3).alias("min_answerable"), _half_up(F.col("hi"), 3).alias("max_no_answer"))


def latest_runs(runs: DataFrame, n: int = 30) -> DataFrame:
    """Newest ``n`` runs per knowledge base with the configuration name read from its JSON, sorted by name."""
    named = runs.withColumn("name", F.get_json_object("config", "$.name"))
    return top_n(named, ["kb_id"], [F.desc("created_at"), F.desc("id")], n).orderBy("kb_id", "name", "id")
