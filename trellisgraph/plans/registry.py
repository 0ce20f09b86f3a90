"""All queries of the graph library by name, and their DuckDB equivalents."""

from __future__ import annotations

import importlib

_found: dict[str, tuple] = {}
_MODULES = ("graph_queries", "text_queries", "training_queries")


def query(name: str, oracle: str | None = None):
    """Registers a function of (spark, sf_dir) under a name, with the SQL that gives the same rows if there is any."""

    def keep(f):
        _found[name] = f, oracle
        return f

    return keep


def _loaded() -> dict[str, tuple]:
    for m in _MODULES:
        importlib.import_module(f"trellisgraph.plans.{m}")
    return _found


def queries() -> dict:
    return {k: f for k, (f, _) in _loaded().items()}


def oracles() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _loaded().items() if sql}
