"""Queries over the driver tables, each next to the SQL that must give the same rows."""

import importlib

_MODULES = ("clean", "search", "catalogue", "rule", "fold", "model", "recovery", "publish", "source", "large")


def load():
    """(queries, SQL twins) of all modules."""
    from verification import registry

    for name in _MODULES:
        importlib.import_module(f"verification.{name}_queries")
    return registry.QUERIES, registry.ORACLES
