"""From documents to a training corpus: stages that each read what the one before kept.

Each stage takes (spark, docs, sf_dir) and returns the columns of documents, the last one the encoded
corpus. Their results are written as Parquet and read again by the next one.

1. language        documents without a language, or with too unsure a one, go
2. near_duplicates of the documents that similar sets of five-word shingles link (Jaccard at least 0.8), the one
                   of smallest doc_id stays
3. decontaminate   documents that hold a benchmark item go
4. personal_data   personal data is replaced by its kind; n_chars follows the new text
5. encode          texts become byte-level BPE ids; the text returned is decoded from these

A document with null doc_id takes part in stages 1, 4 and 5 and is kept by the others; rows that share a
doc_id count as one document. An empty table gives an empty corpus.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from wardline.llm import bpe, decontaminate as templates, langid, pii, shingle_join
from wardline.llm.common import keep, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Least mean probability of the language of a document that stays; texts of two languages reach half.
LEAST_SCORE = 0.35
#: Near duplicates share this part of their shingles of so many words; op2's contract has its own values.
PERCENT, WORDS = 80, 5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    windows, labels = langid.sample(docs, F.lit(True))
    judged = langid.predict(docs, langid.train(windows, labels) if labels else None)
    return judged.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    linked = shingle_join.near_duplicates(docs, percent=PERCENT, words=WORDS)
    gone = keep(linked.filter("doc_id <> component_id").select("doc_id").distinct())
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return templates.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.find(docs, mask=True).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = bpe.encode(docs, "text", ranks, public_tokenizers.PATTERN, "ids", "decoded")
    return coded.select(
        "doc_id",
        F.decode("decoded", "UTF-8").alias("text"),
        "lang",
        "source",
        F.size("ids").cast("long").alias("n_tokens"),
        "ids",
    )


STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("personal_data", personal_data),
    ("encode", encode),
]

#: A learned model, a tagger and a tokenizer cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir))
    return docs
