"""Registered queries of this subpackage and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (chunk_fingerprints, importance, merkle, mixing, pu_quality, quality_rules, secret_scan,
               sentencepiece_codec, simhash, suffix_dedup, token_files, toxicity, warc)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": simhash.op1_simhash,
    "op2_pu_quality": pu_quality.op2_pu_quality,
    "op3_secret_scan": secret_scan.op3_secret_scan,
    "op4_quality_rules": quality_rules.op4_quality_rules,
    "op5_warc": warc.op5_warc,
    "op6_mixing": mixing.op6_mixing,
    "op7_chunk_fingerprints": chunk_fingerprints.op7_chunk_fingerprints,
    "op8_sentencepiece": sentencepiece_codec.op8_sentencepiece,
    "op9_suffix_dedup": suffix_dedup.op9_suffix_dedup,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_token_files": token_files.op11_token_files,
    "op12_merkle_manifest": merkle.op12_merkle_manifest,
    "op13_importance_resampling": importance.op13_importance_resampling,
}

ORACLE_SQL: dict[str, str] = {
    "op3_secret_scan": secret_scan.ORACLE,
    "op4_quality_rules": quality_rules.ORACLE,
    "op5_warc": warc.ORACLE,
    "op9_suffix_dedup": suffix_dedup.ORACLE,
    "op12_merkle_manifest": merkle.ORACLE,
    "op13_importance_resampling": importance.ORACLE,
}
