"""The registry of queries: each plans module exposes QUERIES (name -> callable) and ORACLES (name -> DuckDB SQL)."""

from __future__ import annotations

from quern.plans import cleaning, mixture, relational, sources, telemetry, tokens, training

MODULES: list = [cleaning, telemetry, training, mixture, tokens, relational, sources]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {k: q for m in MODULES for k, q in m.ORACLES.items()}
