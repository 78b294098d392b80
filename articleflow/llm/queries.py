"""Registered queries of the operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from articleflow.llm import (
    alignment,
    chat_format,
    decontaminate,
    language_id,
    licenses,
    merkle,
    quality,
    secrets,
    sentencepiece_codec,
    simhash,
    suffix_dedup,
    token_count,
    toxicity,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark, sf_dir):
    return sentencepiece_codec.encoded_documents(_table(spark, sf_dir, "documents"))


def op2_language_id(spark, sf_dir):
    return language_id.language_report(_table(spark, sf_dir, "documents"))


def op3_chat_format(spark, sf_dir):
    return chat_format.chat_report(_table(spark, sf_dir, "conversations"))


def op4_decontaminate(spark, sf_dir):
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_simhash(spark, sf_dir):
    return simhash.fingerprint_report(_table(spark, sf_dir, "documents"))


def op6_secrets(spark, sf_dir):
    return secrets.secret_report(_table(spark, sf_dir, "documents"))


def op7_quality(spark, sf_dir):
    return quality.quality_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_token_count(spark, sf_dir):
    return token_count.token_report(_table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark, sf_dir):
    return suffix_dedup.removal_report(_table(spark, sf_dir, "documents"))


def op10_licenses(spark, sf_dir):
    return licenses.license_report(_table(spark, sf_dir, "documents"))


def op11_merkle(spark, sf_dir):
    return merkle.manifest_report(_table(spark, sf_dir, "documents"))


def op12_alignment(spark, sf_dir):
    return alignment.alignment_report(_table(spark, sf_dir, "documents"))


def op13_toxicity(spark, sf_dir):
    return toxicity.toxicity_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_sentencepiece, op2_language_id, op3_chat_format, op4_decontaminate, op5_simhash,
                                   op6_secrets, op7_quality, op8_token_count, op9_suffix_dedup, op10_licenses, op11_merkle,
                                   op12_alignment, op13_toxicity)}
