"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from quarry.llm import bpe, lm_scoring, near_dedup, packing, pii, quality_classifier, quality_rules, secrets, token_counts, topk

MODULES = (secrets, near_dedup, topk, packing, token_counts, quality_classifier, quality_rules, bpe, lm_scoring, pii)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.ORACLES.items()}
