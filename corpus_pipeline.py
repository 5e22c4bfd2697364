"""Corpus pipeline: quality rules, line dedup, near-duplicate join, decontamination, BPE coding.

Each stage takes ``(spark, docs, sf_dir)`` and its output is written as Parquet in the
shared folder and reread as the next stage's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stratavox.llm import bpe, decontamination, line_dedup, ngram_join, quality_rules
from stratavox.llm.common import written
from stratavox.llm.queries import bpe_settings, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.filter_documents(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that others repeat; ``n_chars`` follows the text."""
    return line_dedup.rewrite_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: 5-word n-grams, Jaccard similarity from 0.8."""
    return ngram_join.keep_one(docs, ngram_join.JaccardSettings(words=5, percent=80))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.filter_documents(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document left."""
    return bpe.coded(docs, bpe_settings())


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("ngram_join", near_duplicates),
    ("decontamination", decontaminate),
    ("bpe", encode),
]

#: SQL can't express the decontamination and the encoding. The stages' operators are tested, stage 3 also as such.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
