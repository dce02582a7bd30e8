"""All query modules in one place."""

from __future__ import annotations

import importlib

from granary.plans import registry

FLAGSHIP = "o3_scaled_cross_validation"
MODULES = ["profiling", "relational", "preparation", "modeling", "monitoring", "textual", "streams"]

for _name in MODULES:
    importlib.import_module(f"granary.plans.{_name}")


def queries():
    return dict(registry.QUERIES)


def oracle_sql():
    return dict(registry.ORACLES)
