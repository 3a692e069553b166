"""Queries and oracle SQL of the training-data operators, for __spark_entry__.py."""

from __future__ import annotations

from . import byte_bpe, exact_dedup, line_dedup, lm_score, neighbours, packing, sharding, simhash, token_counts, toxicity


def queries():
    return {
        "op1_token_counts": token_counts.op1_token_counts,
        "op2_neighbours": neighbours.op2_neighbours,
        "op3_exact_dedup": exact_dedup.op3_exact_dedup,
        "op4_lm_score": lm_score.op4_lm_score,
        "op5_packing": packing.op5_packing,
        "op6_line_dedup": line_dedup.op6_line_dedup,
        "op7_sharding": sharding.op7_sharding,
        "op8_simhash": simhash.op8_simhash,
        "op9_toxicity": toxicity.op9_toxicity,
        "op10_byte_bpe": byte_bpe.op10_byte_bpe,
    }


def oracle_sql():
    return {"op3_exact_dedup": exact_dedup.OP3_SQL, "op6_line_dedup": line_dedup.OP6_SQL}
