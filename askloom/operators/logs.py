"""Query logs and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from askloom.functions.arrays import rows_of
from askloom.functions.ranking import nth_row, top_n
from askloom.sources.sinks import parse_log


def recent_queries(log: DataFrame, n: int = 50) -> DataFrame:
    """Newest ``n`` queries per knowledge base; without an answer a query came from the debug page."""
    newest = top_n(log.select("id", "kb_id", "question", "latency_ms", "created_at", F.col("answer").isNull().alias("debug_only")),
                   ["kb_id"], [F.desc("id")], n)
    return newest


def query_profile(log: DataFrame) -> DataFrame:
    """One row per logged candidate with the chosen flag and the stage counts; broken JSON keeps one empty row."""
    parsed = parse_log(log)
    return parsed.select("id", "kb_id", F.col("meta.fusedCount").alias("fused_count"), "chosen_ids",
                         F.explode_outer("candidates").alias("c")).select(
        "id", "kb_id", "fused_count", F.col("c.chunkId").alias("chunk_id"), F.col("c.rrfScore").alias("rrf_score"),
        F.coalesce(F.array_contains("chosen_ids", F.col("c.chunkId")), F.lit(False)).alias("chosen"))


def conversation_listing(conversations: DataFrame, messages: DataFrame, n: int = 30) -> DataFrame:
    """Last updated ``n`` conversations per knowledge base and visitor with their message counts, zeros kept."""
    counts = messages.groupBy("conv_id").agg(F.count(F.lit(1)).alias("msg_count"))
    listed = top_n(conversations, ["kb_id", "visitor_id"], [F.desc("updated_at"), F.desc("conv_id")], n)
    return listed.join(counts, "conv_id", "left").withColumn("msg_count", F.coalesce("msg_count", F.lit(0)))


def conversation_messages(messages: DataFrame) -> DataFrame:
    """Messages with their ``position`` from 1 in the conversation."""
    return messages.withColumn("position", F.row_number().over(W.partitionBy("conv_id").orderBy("turn")))


def first_question_flag(messages: DataFrame) -> DataFrame:
    """True while a conversation holds at most one user message, that is before its second one.

    Only the second user message per conversation is looked up; no task reads a whole conversation.
    """
    second = nth_row(messages.filter(F.col("role") == "user"), ["conv_id"], [F.asc("turn")], 2, ["turn"])
    return messages.join(second.withColumnRenamed("turn", "second_turn"), "conv_id", "left").withColumn(
        "first_question", F.coalesce(F.col("turn") < F.col("second_turn"), F.lit(True))).drop("second_turn")


def touch_updated_at(conversations: DataFrame, messages: DataFrame, written: str = "created_at") -> DataFrame:
    """``updated_at`` moved to the latest message, kept where there is none."""
    latest = messages.groupBy("conv_id").agg(F.max(written).alias("_latest"))
    return conversations.join(latest, "conv_id", "left").withColumn(
        "updated_at", F.greatest("updated_at", "_latest")).drop("_latest")
