"""Reading documents and admitting uploads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askloom.functions.ranking import estimated_bytes, nth_row
from askloom.functions.text import base_name, extension, is_blank

# ---- fixed values: admission rules ----
MAX_BYTES = 50 * 1024 * 1024
MAX_DOCS_PER_KB = 100
ALLOWED_TYPES = ("pdf", "docx", "md", "markdown")
# ---- end of fixed values ----

TASK_BYTES = 8 << 20
"""Bytes of stored documents that one task of heavy text work gets."""


def scan_parquet(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """Documents stored as Parquet; only the named columns are read."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def scan_text_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per text file below ``path``: file_name, file_type, size_bytes, reason, text.

    File sizes are in the listing, so a file over the admission limit is not read; it gives a row with the reason ``size`` and no text.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = base_name(F.col("path"))
    listed = [name.alias("file_name"), extension(name).alias("file_type"), F.col("length").alias("size_bytes")]
    none = F.lit(None).cast("string")
    fitting = files.filter(F.col("length") <= MAX_BYTES).select(*listed, none.alias("reason"), F.decode("content", "UTF-8").alias("text"))
    return fitting.unionByName(files.filter(F.col("length") > MAX_BYTES).select(*listed, F.lit("size").alias("reason"), none.alias("text")))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give a scan one shuffle, by ``keys`` or else evenly, so that heavy text work uses every core and a task has ``TASK_BYTES`` of its files at most, however many
    splits the scan has. A scan of that many splits is returned as it is. The sizes are those of the files; nothing runs to learn them."""
    number = max(df.sparkSession.sparkContext.defaultParallelism, -(-estimated_bytes(df) // TASK_BYTES))
    return df.repartition(number, *keys) if keys or df.rdd.getNumPartitions() < number else df


def file_name_parts(files: DataFrame, name: str = "file_name") -> DataFrame:
    """Adds ``base_name`` and ``ext`` (null without one)."""
    return files.withColumn("base_name", base_name(F.col(name))).withColumn("ext", extension(F.col("base_name")))


def judge_uploads(manifest: DataFrame, existing: DataFrame | None = None, max_bytes: int = MAX_BYTES,
                  max_per_kb: int = MAX_DOCS_PER_KB, types: Sequence[str] = ALLOWED_TYPES) -> DataFrame:
    """Uploads (doc_id, kb_id, file_name, size_bytes, created_at) with ``reason`` (null = accepted), ``code``,
    ``base_name`` and ``file_type``.

    Checks in order: empty, knowledge base full, no or wrong extension, too large. A knowledge base is full from
    its ``max_per_kb``-th accepted document on, so only that one row per knowledge base is looked up; no task
    numbers all uploads of one knowledge base. ``existing`` (kb_id, n) counts documents already there.
    """
    named = file_name_parts(manifest)
    empty = is_blank(F.col("file_name")) | F.coalesce(F.col("size_bytes") <= 0, F.lit(True))
    wrong = F.col("ext").isNull() | ~F.col("ext").isin(*types)
    large = F.col("size_bytes") > max_bytes
    at = F.struct("created_at", "doc_id")
    valid = named.filter(~empty & ~wrong & ~large)
    if existing is None:
        limits = nth_row(valid.withColumn("at", at), ["kb_id"], [F.col("at")], max_per_kb, ["at"])
    else:
        room = F.greatest(F.lit(max_per_kb) - F.coalesce("n", F.lit(0)), F.lit(0))
        first = valid.withColumn("at", at).join(existing, "kb_id", "left").withColumn("room", room)
        limits = _last_admitted(first, max_per_kb, existing)
    judged = named.join(limits.withColumnRenamed("at", "full_at"), "kb_id", "left")
    full = F.coalesce(at > F.col("full_at"), F.lit(False))
    return (judged.withColumn("reason", F.when(empty, "empty").when(full, "limit").when(F.col("ext").isNull(), "no_extension")
                              .when(wrong, "type").when(large, "size"))
            .withColumn("code", F.when(F.col("reason") == "size", 413).when(F.col("reason").isNotNull(), 400))
            .withColumn("file_type", F.when(F.col("ext") == "markdown", "md").otherwise(F.col("ext")))
            .drop("ext", "full_at"))


def _last_admitted(first: DataFrame, max_per_kb: int, existing: DataFrame) -> DataFrame:
    from askloom.functions.ranking import top_n

    ranked = top_n(first.select("kb_id", "at", "room"), ["kb_id"], [F.col("at")], max_per_kb, "_rank")
    last = ranked.filter(F.col("_rank") == F.col("room")).select("kb_id", "at")
    return last.unionByName(existing.filter(F.col("n") >= max_per_kb).select(
        "kb_id", F.struct(F.lit("0001-01-01 00:00:00").cast("timestamp").alias("created_at"),
                          F.lit(-1).cast("bigint").alias("doc_id")).alias("at")))


def admit_documents(manifest: DataFrame, **rules) -> tuple[DataFrame, DataFrame]:
    """(accepted with status PENDING, rejected with reason)."""
    judged = judge_uploads(manifest, **rules)
    accepted = judged.filter(F.col("reason").isNull()).drop("reason", "code").withColumn("status", F.lit("PENDING"))
    return accepted, judged.filter(F.col("reason").isNotNull())
