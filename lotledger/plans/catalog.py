"""All registered queries together."""

from __future__ import annotations

from importlib import import_module

from lotledger.plans.registry import Query

MODULES = ["market_queries", "ingest_queries", "operations_queries"]


def _merged(part: str) -> dict:
    out: dict = {}
    for name in MODULES:
        entries = getattr(import_module(f"lotledger.plans.{name}").REGISTRY, part)
        clash = out.keys() & entries.keys()
        if clash:
            raise ValueError(f"registered twice: {sorted(clash)}")
        out |= entries
    return out


def all_queries() -> dict[str, Query]:
    return _merged("queries")


def all_sql() -> dict[str, str]:
    return _merged("sql")
