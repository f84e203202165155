"""Corpus pipeline: toxicity, near duplicates, duplicate substrings, benchmark
passages, tokens.  Each stage takes (spark, docs, sf_dir) and works on all rows
its predecessor kept; its output is written as Parquet and read again as the next
stage's docs.  Part of the ``llm`` subpackage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from stagecraft.llm import bpe, decontam, neardup, substring, toxicity
from stagecraft.llm.common import save


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5; the lexicon is learned from ``labels``."""
    return toxicity.drop_toxic(docs, _table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of each group."""
    return neardup.drop_near_duplicates(docs)


def cut_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of 50-word windows that a smaller document has are cut."""
    return substring.remove_duplicates(docs)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut; documents that are mostly benchmark go."""
    return decontam.remove_benchmark(docs, _table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("toxicity", drop_toxic), ("near duplicates", drop_near_duplicates), ("duplicate substrings", cut_duplicates),
          ("benchmark passages", cut_benchmark), ("tokens", tokens)]

#: SuperMinHash grouping, substring parsing and BPE are not expressible in SQL at
#: this size; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
