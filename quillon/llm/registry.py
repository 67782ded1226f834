"""Queries of this subpackage, by name, and their DuckDB twins where SQL can express them."""

from __future__ import annotations

from quillon.llm import jaccard, lm, mixing, neighbours, pieces, quality, rules, sharding, suffixes, toxicity


OPERATORS = (quality.op1_quality_classifier, mixing.op2_mix_sources, lm.op3_lm_scoring, jaccard.op4_jaccard_join, suffixes.op5_suffix_array_dedup, toxicity.op6_toxicity, neighbours.op7_embedding_near_dedup, sharding.op8_shard_documents, rules.op9_quality_rules, pieces.op10_sentencepiece)


def queries() -> dict:
    return {f.__name__: f for f in OPERATORS}


def oracle_sql() -> dict[str, str]:
    return {"op4_jaccard_join": jaccard.OP4_SQL, "op7_embedding_near_dedup": neighbours.OP7_SQL}
