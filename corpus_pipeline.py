"""Corpus pipeline: language, near duplicates, benchmark passages, personal data, pieces.

Every stage takes the documents its predecessor kept and returns the same columns; the last returns the encoded corpus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askloom.llm import decontamination, language_id, ngram_join, pieces, pii
from askloom.llm.common import read, store
from askloom.session import prepare

LEAST_SCORE = 0.3
"""A text whose best language has a smaller mean probability is in no language the field knows."""


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters whose language is told with some confidence. A missing language is filled in.

    The field learns from the documents that are not held out. Null and empty texts and texts without letters go; without any labelled
    document nothing can be told and nothing stays.
    """
    prepare(spark)
    field = language_id.fit_documents(docs.filter(~F.coalesce(language_id.held_out(), F.lit(False))))
    told = language_id.identify(docs.withColumnsRenamed({c: f"_{c}" for c in docs.columns}), field, "_text")
    kept = told.filter((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= LEAST_SCORE))
    return kept.withColumn("_lang", F.coalesce("_lang", "lang_pred")).select(*[F.col(f"_{c}").alias(c) for c in docs.columns])


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group of near duplicates; rows that repeat its id and text are one.

    Documents with a null id or without words are in no group and stay.
    """
    prepare(spark)
    groups = ngram_join.ngram_components(docs)
    kept = groups.filter("doc_id = component_id").groupBy("doc_id").count()
    rows = docs.join(kept.select("doc_id"), "doc_id", "left_semi")
    if kept.filter("count > 1").limit(1).count():
        rows = rows.dropDuplicates(["doc_id", "text"])
    return rows.unionByName(docs.filter("doc_id IS NULL")).select(*docs.columns)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage like a benchmark item; those with one go whole."""
    prepare(spark)
    found = decontamination.leaks(docs, read(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind in brackets; n_chars follows the text."""
    prepare(spark)
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_chars, n_pieces, piece_ids) of all documents."""
    prepare(spark)
    coded = pieces.encode(docs, "text", "piece_ids")
    return coded.select("doc_id", "lang", "source", "n_chars", F.coalesce(F.size("piece_ids"), F.lit(0)).cast("long").alias("n_pieces"), "piece_ids")


STAGES = [
    ("language", keep_known_languages),
    ("near_duplicates", keep_one_of_each_group),
    ("benchmark", drop_benchmark_passages),
    ("personal_data", redact_personal_data),
    ("pieces", encode_pieces),
]

ORACLE_SQL = None  # a trained field and exact clustering of whole texts are not SQL; tests compare with plain Python


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's result is written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
