"""All queries of the engine and their SQL twins."""

from __future__ import annotations

from importlib import import_module

from gallerist.plans import registry

MODULES = ("recognition", "galleries", "evaluation", "video", "leakage", "selection", "experiments", "comparisons", "diagnostics", "relational")


def _load() -> None:
    for m in MODULES:
        import_module(f"gallerist.plans.{m}")


def queries() -> dict:
    _load()
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(registry.SQL)
