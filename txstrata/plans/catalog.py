"""All queries of the engine, and their SQL."""

from __future__ import annotations

from . import analytics, ingestion, learned, registry, structure

for _module in (analytics, structure, ingestion, learned):
    _module.register_all()


def queries() -> dict[str, registry.Query]:
    return registry.QUERIES


def oracle_sql() -> dict[str, str]:
    return registry.ORACLES
