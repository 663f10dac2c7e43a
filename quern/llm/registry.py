"""All queries of this subpackage."""

from __future__ import annotations

from quern.llm import bpe, chat, decontam, grammar, lm, neardup, quality, sharding, toxicity, urls

MODULES = [decontam, urls, chat, bpe, grammar, neardup, lm, quality, sharding, toxicity]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {k: q for m in MODULES for k, q in m.ORACLES.items()}
