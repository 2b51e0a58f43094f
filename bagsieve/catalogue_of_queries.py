"""The queries of the library and their SQL, by name."""

from __future__ import annotations

import importlib

from .plans import registry

MODULES = ("vector_queries", "selection_queries", "table_queries", "metric_queries", "pool_queries", "bag_queries")

for _name in MODULES:
    importlib.import_module(f"{__package__}.plans.{_name}")


def queries():
    return dict(registry.QUERIES)


def oracle_sql():
    return dict(registry.ORACLES)
