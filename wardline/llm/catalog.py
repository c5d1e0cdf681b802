"""Registered queries of this package and, where SQL can express one, the SQL it is checked against."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from wardline.llm import (
    bpe,
    chat,
    decontaminate,
    langid,
    packing,
    periodic,
    pii,
    quality_model,
    quality_rules,
    repeats,
    shingle_join,
    warc,
    whitening,
)
from wardline.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str) -> Callable:
    def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = fn
        return fn

    return register


@query("op1_bpe_round_trip")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts to ids and back."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.token_digests(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


@query("op2_shingle_join")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose shingle sets are similar."""
    return shingle_join.near_duplicates(table(spark, sf_dir, "documents"))


@query("op3_chat_format")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with repaired roles, rendered."""
    return chat.format_chats(table(spark, sf_dir, "conversations"))


@query("op4_warc_archives")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as archives and read back."""
    return warc.round_trip(table(spark, sf_dir, "pages"), min_bytes=0)


@query("op5_language_id")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    return langid.languages(table(spark, sf_dir, "documents"))


@query("op6_personal_data")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return pii.report(table(spark, sf_dir, "documents"))


@query("op7_quality_classifier")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return quality_model.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op8_suffix_repeats")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without strings that stand in an earlier one."""
    return repeats.report(table(spark, sf_dir, "documents"))


@query("op9_benchmark_templates")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items, also with other numbers or names."""
    return decontaminate.verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


CHECKS["op10_quality_rules"] = quality_rules.check_sql()


@query("op10_quality_rules")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of the threshold table for every document."""
    return quality_rules.verdicts(table(spark, sf_dir, "documents"))


@query("op11_periodic_runs")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in every document, with a tenth of them made periodic."""
    return periodic.report(table(spark, sf_dir, "documents"))


@query("op12_best_fit_packing")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token pieces of all documents packed into sequences of 4096."""
    return packing.report(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op13_embedding_whitening")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First components of all embeddings, whitened."""
    return whitening.report(table(spark, sf_dir, "embeddings"))
