"""Queries of this package by name, with their SQL oracles."""

from __future__ import annotations

from brindle.llm import (
    bpe, decontamination, language_id, merkle_manifest, near_dedup, quality_classifier, quality_rules, secret_scans, sharding, source_divergence, source_mixing,
    token_output, toxicity,
)

QUERIES = {
    "op1_token_output": token_output.op1_token_output,
    "op7_byte_level_bpe": bpe.op7_byte_level_bpe,
    "op2_toxicity": toxicity.op2_toxicity,
    "op4_benchmark_decontamination": decontamination.op4_benchmark_decontamination,
    "op9_minhash_near_dedup": near_dedup.op9_minhash_near_dedup,
    "op3_quality_classifier": quality_classifier.op3_quality_classifier,
    "op6_language_id": language_id.op6_language_id,
    "op5_secret_scans": secret_scans.op5_secret_scans,
    "op8_sharding": sharding.op8_sharding,
    "op10_quality_rules": quality_rules.op10_quality_rules,
    "op11_merkle_manifest": merkle_manifest.op11_merkle_manifest,
    "op12_source_mixing": source_mixing.op12_source_mixing,
    "op13_source_divergence": source_divergence.op13_source_divergence,
}

ORACLES = {
    "op5_secret_scans": secret_scans.ORACLE,
    "op10_quality_rules": quality_rules.ORACLE,
    "op11_merkle_manifest": merkle_manifest.ORACLE,
    "op12_source_mixing": source_mixing.ORACLE,
    "op13_source_divergence": source_divergence.ORACLE,
}
