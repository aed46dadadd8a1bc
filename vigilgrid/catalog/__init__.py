"""Runnable queries over the driver's tables, one module per part of the inventory."""

from __future__ import annotations

from importlib import import_module

from vigilgrid.catalog.registry import ENTRIES, Entry

MODULES = ["analytics", "predicates", "joining", "ordering", "scalars", "shapes", "search", "identity",
           "alerting", "governance", "evaluation", "storage", "live"]


def load() -> dict[str, Entry]:
    for module in MODULES:
        import_module(f"vigilgrid.catalog.{module}")
    return dict(ENTRIES)
