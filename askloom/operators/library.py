"""Knowledge bases, documents and chunks: access, listings, roll-ups, samples, clean-up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from askloom.functions.ranking import top_n
from askloom.functions.text import is_blank, trim_controls

# ---- fixed values ----
FINGERPRINT_FACTOR = 10000003
CHAPTERS = 4
QUIZ_UNITS = 6
SUGGEST_UNITS = 8
INTERRUPTED = ("PENDING", "PARSING", "INDEXING")
INTERRUPTED_MESSAGE = "服务重启导致解析中断，请删除后重新上传"
# ---- end of fixed values ----


def accessible(rows: DataFrame, kb_visitor: DataFrame, visitor: str = "visitor_id") -> DataFrame:
    """Rows of knowledge bases their visitor is bound to."""
    return rows.join(kb_visitor.select("kb_id", F.col("visitor_id").alias(visitor)), ["kb_id", visitor], "left_semi")


def kb_listing(kb: DataFrame, kb_visitor: DataFrame, documents: DataFrame) -> DataFrame:
    """Knowledge bases per visitor with document count, owner flag and position, newest first.

    Documents are counted per knowledge base before the join.
    """
    counts = documents.groupBy("kb_id").agg(F.count(F.lit(1)).alias("doc_count"))
    rows = (kb_visitor.select("kb_id", "visitor_id").join(kb, "kb_id").join(counts, "kb_id", "left")
            .withColumn("doc_count", F.coalesce("doc_count", F.lit(0)))
            .withColumn("is_owner", F.coalesce(F.col("created_by") == F.col("visitor_id"), F.lit(False))))
    newest = W.partitionBy("visitor_id").orderBy(F.desc("created_at"), F.desc("kb_id"))
    return rows.withColumn("position", F.row_number().over(newest))


def join_by_code(requests: DataFrame, kb: DataFrame, kb_visitor: DataFrame) -> DataFrame:
    """New bindings (kb_id, visitor_id) from requests (visitor_id, code); known ones and repeats add nothing."""
    coded = requests.select("visitor_id", F.upper(trim_controls(F.col("code"))).alias("share_code"))
    found = coded.join(kb.select("kb_id", "share_code"), "share_code").select("kb_id", "visitor_id")
    return found.join(kb_visitor, ["kb_id", "visitor_id"], "left_anti").dropDuplicates(["kb_id", "visitor_id"])


def documents_by_kb(documents: DataFrame) -> DataFrame:
    """Document listing: ``position`` from 1 inside each knowledge base, newest first. Admission bounds the documents of a knowledge base."""
    return documents.withColumn("position", F.row_number().over(W.partitionBy("kb_id").orderBy(F.desc("created_at"), F.desc("doc_id"))))


def document_counts(documents: DataFrame) -> DataFrame:
    return documents.groupBy("kb_id").agg(F.count(F.lit(1)).alias("doc_count"))


def library_readiness(documents: DataFrame) -> DataFrame:
    """Ready documents, all documents and whether some are still being worked on, per knowledge base."""
    return documents.groupBy("kb_id").agg(
        F.count_if(F.col("status") == "READY").alias("ready_count"), F.count(F.lit(1)).alias("doc_count"),
        F.bool_or(F.col("status").isin(*INTERRUPTED)).alias("processing"))


def recover_interrupted(documents: DataFrame) -> DataFrame:
    """Documents left in a middle state become FAILED with a message."""
    broken = F.col("status").isin(*INTERRUPTED)
    return (documents.withColumn("error_msg", F.when(broken, F.lit(INTERRUPTED_MESSAGE)).otherwise(F.col("error_msg")))
            .withColumn("status", F.when(broken, F.lit("FAILED")).otherwise(F.col("status"))))


def cascade_delete(deleted: DataFrame, tables: Sequence[tuple[str, DataFrame, str, str, str]]) -> dict[str, DataFrame]:
    """Remaining rows of each table after deleting ``deleted`` (one id column).

    ``tables`` lists (name, rows, id column, parent table name or '' for the root, parent id column), parents
    first. The ids that vanish from a table are passed down to its children as semi and anti joins.
    """
    root = deleted.columns[0]
    gone: dict[str, DataFrame] = {"": deleted.select(F.col(root).alias("_gone"))}
    left: dict[str, DataFrame] = {}
    for name, rows, id_col, parent, parent_col in tables:
        ids = gone[parent].withColumnRenamed("_gone", parent_col)
        left[name] = rows.join(ids, parent_col, "left_anti")
        gone[name] = rows.join(ids, parent_col, "left_semi").select(F.col(id_col).alias("_gone"))
    return left


def chapter_rollup(chunks: DataFrame) -> DataFrame:
    """Chapters per knowledge base: first part of the section path, chunks, first page, in order of first chunk."""
    chapter = F.element_at(F.split("section_path", " > ", -1), 1)
    rows = chunks.filter(F.col("section_path").isNotNull()).groupBy("kb_id", chapter.alias("chapter")).agg(
        F.count(F.lit(1)).alias("chunks"), F.min("page_no").alias("start_page"), F.min("chunk_index").alias("first_index"))
    return rows.orderBy("kb_id", "first_index", "chapter")


def chapter_names(chunks: DataFrame, n: int = CHAPTERS) -> DataFrame:
    """First ``n`` distinct chapter names per knowledge base; blank names drop out after the cut."""
    chapter = F.element_at(F.split("section_path", " > ", -1), 1)
    names = chunks.filter(F.col("section_path").isNotNull()).select("kb_id", chapter.alias("chapter")).distinct()
    return top_n(names, ["kb_id"], [F.asc("chapter")], n).filter(~is_blank(F.col("chapter")))


def corpus_fingerprint(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("kb_id").agg(
        (F.count(F.lit(1)) * FINGERPRINT_FACTOR + F.coalesce(F.max("chunk_id"), F.lit(0))).alias("fingerprint"))


def unit_scope(chunks: DataFrame, documents: DataFrame, kb: DataFrame | None = None, only: DataFrame | None = None) -> DataFrame:
    """Units that may be drawn, (kb_id, unit_id, doc_id, strategy, section_path): chunks without a parent of READY documents.

    With ``kb`` (kb_id, chunk_strategy) only those of the knowledge base's own strategy, structure-aware where it names none; with ``only`` (doc_id) only
    those of the listed documents.
    """
    ready = documents.filter(F.col("status") == "READY").select("doc_id", "kb_id")
    if only is not None:
        ready = ready.join(only.select("doc_id").distinct(), "doc_id", "left_semi")
    units = chunks.filter(F.col("parent_id").isNull()).select("doc_id", "strategy", F.col("chunk_id").alias("unit_id"), "section_path").join(ready, "doc_id")
    if kb is not None:
        units = units.join(kb.select("kb_id", F.coalesce("chunk_strategy", F.lit("STRUCTURE_AWARE")).alias("strategy")), ["kb_id", "strategy"], "left_semi")
    return units.select("kb_id", "unit_id", "doc_id", "strategy", "section_path")


def sample_units(units: DataFrame, n: int = QUIZ_UNITS, seed: str = "0", section_prefix: str | None = None,
                 minimum: int = 2) -> DataFrame:
    """``n`` random units per knowledge base in an order fixed by ``seed``; fewer than ``minimum`` give none.

    units (kb_id, unit_id, section_path). The prefix is literal text, so ``%`` and ``_`` need no escape.
    """
    rows = units
    if section_prefix is not None and section_prefix.strip():
        rows = rows.filter(F.col("section_path").startswith(section_prefix.strip()))
    order = F.md5(F.concat_ws("|", F.lit(seed), F.col("unit_id").cast("string")).cast("binary"))
    drawn = top_n(rows.withColumn("_key", order), ["kb_id"], [F.asc("_key"), F.asc("unit_id")], n, "unit_no").drop("_key")
    enough = drawn.groupBy("kb_id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= minimum)
    return drawn.join(enough, "kb_id", "left_semi")


def source_text(requests: DataFrame, chunks: DataFrame, chars: int = 4000) -> DataFrame:
    """Contents of the listed chunk ids (req_id, chunk_ids), each with a blank line, cut to ``chars``.

    The ids of a question are few; they are joined by equality and put together in id order.
    """
    wanted = requests.select("req_id", F.explode(F.array_distinct("chunk_ids")).alias("chunk_id"))
    found = wanted.join(chunks.select("chunk_id", "content"), "chunk_id").groupBy("req_id").agg(
        F.array_sort(F.collect_list(F.struct("chunk_id", "content"))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: F.concat(p["content"], F.lit("\n\n"))), "")
    return requests.select("req_id").join(found, "req_id", "left").select(
        "req_id", F.coalesce(F.substring(text, 1, chars), F.lit("")).alias("source_text"))
