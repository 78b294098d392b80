"""The document pipeline: quality rules, near-duplicate removal, benchmark
decontamination, secret redaction, SentencePiece encoding.

Each stage reads what its predecessor wrote and works on all of it; all but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from articleflow.llm import decontaminate, quality, secrets, sentencepiece_codec, simhash
from articleflow.llm.common import ready, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or a justified cutoff reject go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return simhash.one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mask; every document stays."""
    return secrets.redact(docs)


def sentencepiece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids, round_trip of the texts that are left."""
    return sentencepiece_codec.encoded_documents(docs)


STAGES = [("quality rules", quality_rules), ("SimHash near-dedup", simhash_near_dedup),
          ("benchmark decontamination", benchmark_decontamination), ("secret scans", secret_scans),
          ("SentencePiece encoding and decoding", sentencepiece_encoding)]

#: Fingerprints (XXH64) and encoding have no SQL form; tests compare run()
#: with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"stage{i}")
    return docs
