"""The stages of the corpus pipeline: (spark, docs, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, quality, simhash, substrings
from .common import read_table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the classifier doesn't reject; it learns from those of docs that have a label.  Nulls and repeats as in keep_good()."""
    return quality.keep_good(docs, quality.train(docs, quality.training_labels(read_table(spark, sf_dir, "labels"))))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the smallest id, of each group of near-duplicates.  Nulls and repeats as in keep_one()."""
    return simhash.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes the words that repeated windows cover; n_chars follows the text.  Nulls and repeats as in remove_repeats()."""
    return substrings.remove_repeats(docs).withColumn("n_chars", F.length("text").cast("long"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that hold no benchmark item.  Nulls and repeats as in leaks(); rows without a doc_id stay."""
    return decontaminate.without_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids of each text, and whether the ids decode to the text; null texts count as empty, an empty table gives an empty one."""
    return bpe.encode_checked(docs, bpe.vocabulary("byte_bpe_50k.json"))
