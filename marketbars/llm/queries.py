"""The registered queries of the numbered operators: each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    byte_bpe, chat_rotation, decontaminate, language_id, license_scan, pii_bootstrap, quality_rules, sentencepiece_codec, simhash, suffix_dedup, token_alignment, warc_zstd, whitening,
)
from .common import table


def _over(name: str, operator: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(table(spark, sf_dir, name))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.op6(table(spark, sf_dir, "documents"), "piece_bpe_32k.model")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.op9(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.op12(table(spark, sf_dir, "documents"), "byte_bpe_50k.tiktoken", _pattern())


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.op13(table(spark, sf_dir, "documents"), "byte_bpe_50k.json", "piece_bpe_32k.model", _pattern())


def _pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_license_scans": _over("documents", license_scan.op1),
        "op2_language_id": _over("documents", language_id.op2),
        "op3_chat_rotation": _over("conversations", chat_rotation.op3),
        "op4_pii": _over("documents", pii_bootstrap.op4),
        "op5_suffix_dedup": _over("documents", suffix_dedup.op5),
        "op6_sentencepiece": op6_sentencepiece,
        "op7_quality_rules": _over("documents", quality_rules.op7),
        "op8_simhash": _over("documents", simhash.op8),
        "op9_decontamination": op9_decontamination,
        "op10_warc": _over("pages", warc_zstd.op10),
        "op11_whitening": _over("embeddings", whitening.op11),
        "op12_byte_bpe": op12_byte_bpe,
        "op13_token_alignment": op13_token_alignment,
    }
