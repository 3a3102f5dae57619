"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from maskwell.llm import bpe, fingerprints, jaccard, language, packed_ids, passages, pivots, pseudo_likelihood, raking, toxicity

MODULES = (bpe, fingerprints, jaccard, language, packed_ids, passages, pivots, pseudo_likelihood, raking, toxicity)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in MODULES for k, s in m.ORACLE_SQL.items()}
