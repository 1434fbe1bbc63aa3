"""Registered queries of the subpackage and their check SQL."""

from __future__ import annotations

from devicepulse.llm import (
    exact_dedup,
    fill_middle,
    minhash,
    mixing,
    negatives,
    packing,
    quality,
    repeats,
    secrets,
    sharding,
    token_counts,
    toxicity,
    vectors,
)

QUERIES = {
    "op1_secrets": secrets.op1,
    "op2_mixing": mixing.op2,
    "op3_near_vectors": vectors.op3,
    "op4_token_counts": token_counts.op4,
    "op5_minhash": minhash.op5,
    "op6_exact_dedup": exact_dedup.op6,
    "op7_byte_shards": sharding.op7,
    "op8_packing": packing.op8,
    "op9_toxicity": toxicity.op9,
    "op10_quality": quality.op10,
    "op11_hard_negatives": negatives.op11,
    "op12_fill_middle": fill_middle.op12,
    "op13_repeats": repeats.op13,
}
ORACLE = {
    "op6_exact_dedup": exact_dedup.SQL,
    "op11_hard_negatives": negatives.SQL,
    "op12_fill_middle": fill_middle.SQL,
}
