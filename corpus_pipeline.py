"""A corpus pipeline of the numbered operators; each stage works on all that its predecessor kept.

Each function takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet in the shared folder
and reads again as the next stage's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marketbars.llm import common, decontaminate, pii_bootstrap, quality_rules, sentencepiece_codec, simhash


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the threshold table."""
    return quality_rules.passing(docs)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest doc_id."""
    return simhash.deduplicate(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no item of the benchmark."""
    return decontaminate.decontaminate(docs, common.table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return pii_bootstrap.redact(docs)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of tokens and digests of ids and decoded text for each document."""
    return sentencepiece_codec.op6(docs, "piece_bpe_32k.model")


STAGES = [
    ("quality rules", quality_stage),
    ("SimHash near-dedup", simhash_stage),
    ("benchmark decontamination", decontamination_stage),
    ("PII", pii_stage),
    ("SentencePiece encoding", tokens_stage),
]

#: SimHash, decontamination, bootstrapping and SentencePiece are beyond SQL; tests/llm hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; what a stage writes on its way is deleted when its result is written."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = common.new_dir(spark, name.replace(" ", "_"))
        with common.temporary(spark):
            docs = common.keep(stage(spark, docs, sf_dir), name, path)
    return docs
