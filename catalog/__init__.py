"""Registered queries on the driver tables and their DuckDB counterparts."""

from __future__ import annotations

import importlib

MODULES = ("normalisation", "analytics", "joins", "matching", "ingestion", "extraction", "streams")


def _registered():
    for name in MODULES:
        importlib.import_module(f"catalog.{name}")
    from catalog import registry

    return registry


def all_queries() -> dict:
    return dict(_registered().QUERIES)


def all_oracles() -> dict[str, str]:
    return dict(_registered().ORACLES)
