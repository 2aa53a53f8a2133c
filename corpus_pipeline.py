"""The corpus pipeline: quality, near-duplicates, benchmark, mixture, token files."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import decontaminate, mixing, near_duplicates, quality_classifier, token_files
from graphloom.llm.common import discard, materialize, table

#: Words whose ids a Python worker keeps in each of two generations.
KEPT_WORDS = 250_000


# Every stage takes a table with at least the columns of documents (more of them, whatever their names,
# are handed through until the last stage) and gives an empty one for an empty one. No stage drops a row for
# a null or empty text or for a null doc_id; what else becomes of such rows, and of repeated ones, is said below.


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from the labels outside the held-out fold.

    Rows are judged by their texts alone: equal texts stay or go together, null ones count as empty.
    """
    return quality_classifier.accepted(docs, table(spark, sf_dir, "labels"))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five words, similarity 0.8): the one with the least doc_id.

    Texts without words resemble nothing and stay, as do rows without doc_id; rows that share a doc_id stay or go together.
    """
    return near_duplicates.representatives(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window. Texts without words have none; equal texts stay or go together."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, those of smaller sources repeated up to the limit.

    A null source is a source of its own; rows that share a doc_id are drawn one by one.
    """
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in doc_id order; a row for each document read back from them.

    Null texts have the end token alone; rows without doc_id come first, repeated rows by text.
    Executors still hold memory of the stages before, so workers keep fewer words than by default.
    """
    return token_files.token_output(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2, kept_words=KEPT_WORDS)


STAGES = [("quality classifier", quality), ("MinHash near-dedup", dedup), ("benchmark decontamination", clean), ("mixing sources", mixture), ("token output", tokens)]
#: The classifier is trained and the tokens come from a library, so there is no SQL: tests/llm/test_pipeline.py
#: holds each stage's rows against a plain answer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the table documents, each written and read again; a stage's table goes once the next is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"pipeline-{name.split()[0]}")
        discard(before)
    return docs
