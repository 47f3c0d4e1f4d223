"""A training corpus from raw documents: stages in order, each written as Parquet and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sigstrata.llm import mixing, quality_rules, secrets, sentencepiece_codec, simhash_dedup
from sigstrata.llm.common import discard, materialize, scratch, table, tokenizer_path

#: Token shares of the mix, and its tokens as a multiple of those at hand: with these a document that is mostly of the
#: domain that is short of its share is not thinned.
MIX = {"good": 0.86, "poor": 0.10, "toxic": 0.04}
BUDGET = 1.2


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.filter_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_dedup.keep_one(docs)


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact_documents(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs, table(spark, sf_dir, "labels"), materialize, MIX, budget=BUDGET, strict=True)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_documents(docs, tokenizer_path(sentencepiece_codec.MODEL))


STAGES = [
    ("quality_rules", quality),
    ("simhash_dedup", near_duplicates),
    ("secret_scan", secret_redaction),
    ("mixing", mix),
    ("sentencepiece", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents through all stages. Tables between stages, and those within, go when the next one is written."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with scratch() as keep:
            made = keep(materialize(stage(spark, docs, sf_dir)))
        discard(docs)
        docs = made
    return STAGES[-1][1](spark, docs, sf_dir)


#: EM, shingle sets and the encoder have no SQL equivalent; tests/llm holds the stages against brute force.
ORACLE_SQL = None
