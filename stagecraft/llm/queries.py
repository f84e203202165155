"""Registered queries of the operators (and the pipeline), each over its
whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from stagecraft.llm import (bpe, decontam, filteraudit, htmltext, langid, license, neardup, oracle, quality, sharding, substring, suffix, toxicity,
                            veccodes)

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str):
    def deco(fn):
        REGISTRY[name] = fn
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@query("op1_quality")
def q_quality(spark, sf_dir):
    return quality.quality(table(spark, sf_dir, "documents"))


SQL["op1_quality"] = quality.SQL


#: The base phrases of op4's contract.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


@query("op4_licenses")
def q_licenses(spark, sf_dir):
    return license.licenses(table(spark, sf_dir, "documents"), phrases=PHRASES)


@query("op10_sharding")
def q_sharding(spark, sf_dir):
    return sharding.shard(table(spark, sf_dir, "documents"))


@query("op3_substring_dedup")
def q_substring(spark, sf_dir):
    return substring.substring_dedup(table(spark, sf_dir, "documents"))


@query("op2_near_duplicates")
def q_near_duplicates(spark, sf_dir):
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


@query("op5_toxicity")
def q_toxicity(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op6_byte_bpe")
def q_byte_bpe(spark, sf_dir):
    return bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query("op7_language")
def q_language(spark, sf_dir):
    return langid.language(table(spark, sf_dir, "documents"))


@query("op8_decontamination")
def q_decontamination(spark, sf_dir):
    return decontam.decontamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op9_suffix_dedup")
def q_suffix(spark, sf_dir):
    return suffix.suffix_dedup(table(spark, sf_dir, "documents"))


@query("op11_main_text")
def q_main_text(spark, sf_dir):
    return htmltext.extract(table(spark, sf_dir, "pages"))


@query("op12_filter_audit")
def q_filter_audit(spark, sf_dir):
    return filteraudit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL["op12_filter_audit"] = filteraudit.SQL


@query("op13_vector_codes")
def q_vector_codes(spark, sf_dir):
    return veccodes.vector_codes(table(spark, sf_dir, "embeddings"))


SQL["op13_vector_codes"] = veccodes.sql()


SQL["op2_near_duplicates"] = oracle.NEAR_DUPLICATES
SQL["op3_substring_dedup"] = oracle.SUBSTRING
SQL["op8_decontamination"] = oracle.DECONTAMINATION
SQL["op9_suffix_dedup"] = oracle.SUFFIX


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(REGISTRY)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
