"""Queries and SQL of this subpackage, for the driver contract."""

from __future__ import annotations

from specweave.llm import bpe, embedding, exact, langid, mixing, quality, secret_scan, sharding, simhash, substring

QUERIES = {
    "op2_substrings": substring.op2_substrings,
    "op4_embedding": embedding.op4_embedding,
    "op6_quality": quality.op6_quality,
    "op3_secrets": secret_scan.op3_secrets,
    "op8_language": langid.op8_language,
    "op9_bpe": bpe.op9_bpe,
    "op1_simhash": simhash.op1_simhash,
    "op10_exact_dedup": exact.op10_exact_dedup,
    "op5_shards": sharding.op5_shards,
    "op7_mix": mixing.op7_mix,
}

ORACLE = {
    "op10_exact_dedup": exact.SQL,
    "op7_mix": mixing.SQL,
}
