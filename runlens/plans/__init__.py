"""Registered queries: each operator over the driver's tables, with its SQL twin."""

from __future__ import annotations

from importlib import import_module

FAMILIES = ["benchmark", "events", "ledger", "costs", "artifacts", "validate", "catalogue", "sources", "streams"]


def _load() -> None:
    for family in FAMILIES:
        import_module(f"runlens.plans.{family}")


def all_queries() -> dict:
    from runlens.plans.registry import QUERIES

    _load()
    return dict(QUERIES)


def all_oracles() -> dict:
    from runlens.plans.bindings import expand
    from runlens.plans.registry import ORACLES

    _load()
    return {name: expand(sql) for name, sql in ORACLES.items()}
