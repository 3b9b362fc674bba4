"""Reading card of a chunk: its document, parent, neighbours and the parent paragraphs to highlight."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askloom.functions.arrays import rows_of
from askloom.functions.text import is_blank

HIGHLIGHT_KEY_CHARS = 20
HIGHLIGHT_MAX_OFFSET = 5


def chunk_context(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunk with document, parent content and the neighbour children at ``chunk_index`` ± 1 (a gap gives null).

    chunks (chunk_id, doc_id, chunk_index, parent_id, content, ...); a column ``strategy`` keeps chunks of several strategies apart. Each
    child is handed to its two neighbour positions and grouped with the chunk there, so one shuffle by (document, strategy, position)
    serves both neighbours and no document is gathered in one task.
    """
    keys = ["doc_id", "strategy"] if "strategy" in chunks.columns else ["doc_id"]
    own = F.struct("chunk_id", "parent_id", "content", "section_path", "page_no")
    own_rows = chunks.select(*keys, "chunk_index", own.alias("c"), F.lit(None).cast("string").alias("prev_content"),
                             F.lit(None).cast("string").alias("next_content"))
    kind = own_rows.schema["c"].dataType

    def offer(step: int, name: str) -> DataFrame:
        other = "next_content" if name == "prev_content" else "prev_content"
        return chunks.filter(F.col("parent_id").isNotNull()).select(
            *keys, (F.col("chunk_index") + step).alias("chunk_index"), F.lit(None).cast(kind).alias("c"),
            F.col("content").alias(name), F.lit(None).cast("string").alias(other))

    rows = own_rows.unionByName(offer(1, "prev_content")).unionByName(offer(-1, "next_content"))
    cards = rows.groupBy(*keys, "chunk_index").agg(
        F.max("c").alias("c"), F.max("prev_content").alias("prev_content"), F.max("next_content").alias("next_content"))
    cards = cards.filter("c is not null").select("doc_id", "chunk_index", "c.*", "prev_content", "next_content")
    parents = chunks.select(F.col("chunk_id").alias("parent_id"), F.lit(0).cast("bigint").alias("_share"), F.col("content").alias("parent_content"))
    # chunks without a parent meet nothing; a share of their own keeps them out of one task
    share = F.when(F.col("parent_id").isNull(), F.xxhash64("chunk_id")).otherwise(F.lit(0).cast("bigint"))
    return (cards.join(documents.select("doc_id", "kb_id", "file_name"), "doc_id")
            .withColumn("_share", share).join(parents, ["parent_id", "_share"], "left").drop("_share"))


def highlight_paragraphs(cards: DataFrame) -> DataFrame:
    """Paragraphs of the parent with ``hit`` where the child begins: its first characters occur near the start."""
    def begin(c: str, n: int) -> Column:
        """The first ``n`` characters without white space; the rest of the text is not looked at."""
        return F.regexp_replace(F.regexp_extract(c, rf"\A(?:\s*+\S){{0,{n}}}", 0), r"\s+", "")

    key = begin("content", HIGHLIGHT_KEY_CHARS)
    paragraphs = F.filter(F.split("parent_content", r"\n+", -1), lambda p: ~is_blank(p))
    rows = rows_of(cards.filter("parent_content is not null").withColumn("key", key), paragraphs, "chunk_id", "key", item="text")
    at = F.instr(begin("text", HIGHLIGHT_KEY_CHARS + HIGHLIGHT_MAX_OFFSET - 1), F.col("key"))
    return rows.select("chunk_id", "pos", "text", ((F.length("key") > 0) & at.between(1, HIGHLIGHT_MAX_OFFSET)).alias("hit"))
