"""Query plans composed from the operators."""

import importlib

_MODULES = ["dashboards", "texts", "labels", "models", "stores", "streams", "corpora", "pages"]


def load_queries():
    """Import every module that registers queries and return the catalog."""
    for name in _MODULES:
        importlib.import_module(f"hazardlake.plans.{name}")
    return importlib.import_module("hazardlake.plans.catalog")
