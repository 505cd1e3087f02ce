"""The corpus pipeline: five operators one after the other, each written and reread.

Language identification and the quality classifier drop the documents that they
reject, near-copies keep one document of each group of texts with a similarity of
0.8 or more over five words, benchmark decontamination drops documents that hold
a test item, and what is left is packed into sequences. Every stage works on all
rows that the one before it kept.

All stages judge a row by its own text: rows of one ``doc_id``, or of none, stay
apart. Columns besides ``doc_id``, ``text`` and, to learn from, ``lang`` are kept
as they are, whatever their names. An empty table goes through as one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import decontamination, language, packing, quality, simhash
from quillon.llm.registry import table, tokenizer_file
from quillon.plans.staging import stage


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language; null texts and those without a letter go."""
    return language.filter_language(docs, language.train(docs))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold; all, where no label of either kind is known."""
    return quality.filter_quality(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: one with the smallest id, without ids one by its text's hash."""
    return simhash.representatives(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; all, where the benchmark is empty."""
    return decontamination.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in packed sequences; an empty text is its end token."""
    return packing.pack_documents(docs, tokenizer_file("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("quality_classifier", keep_quality),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("best_fit_packing", pack_sequences),
]

#: The stages are models, trees and bin plans, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, function) in enumerate(STAGES):
        docs = function(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, name)
    return docs
