"""The corpus pipeline: stages over `documents`, each stored as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronoloom.llm import stages
from chronoloom.llm.common import read_table, settle

STAGES = [
    ("quality_classifier", stages.quality_filter),
    ("simhash_near_dedup", stages.near_dedup),
    ("substring_dedup", stages.substring_dedup),
    ("benchmark_decontamination", stages.decontamination),
    ("bpe_encoding", stages.encoding),
]

#: A trained model, fingerprints by XXH64 and byte-pair merges have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = settle(docs, name)
    return docs
