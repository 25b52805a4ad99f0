"""All queries of the library, by name."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from .catalog import OPERATORS

#: Modules that register SQL plans, and modules with queries of their own
#: (``QUERIES``: name to function; ``SQL``: name to oracle text; ``COVERS``).
PLAN_MODULES = ("ingest", "scalar", "rules", "features", "flags", "reports", "graph", "scoring", "osint", "extraction")
CODE_MODULES = (
    "operators.iterative", "operators.models", "sources.generate", "sources.typologies", "streaming.account_state", "streaming.account_signals",
    "streaming.keyed_log", "streaming.node_memory", "streaming.account_store", "sources.landing",
)

Query = Callable[[SparkSession, str], DataFrame]


def _load() -> list:
    for name in PLAN_MODULES:
        import_module(f"ledgergraph.operators.{name}")
    return [import_module(f"ledgergraph.{name}") for name in CODE_MODULES]


def queries() -> dict[str, Query]:
    modules = _load()
    found: dict[str, Query] = {name: op.query for name, op in OPERATORS.items()}
    for module in modules:
        found.update(module.QUERIES)
    return found


def oracle_sql() -> dict[str, str]:
    modules = _load()
    found = {name: op.oracle() for name, op in OPERATORS.items()}
    for module in modules:
        found.update(module.SQL)
    return found


def coverage() -> dict[str, list[str]]:
    """Inventory id to the queries that cover it."""
    modules = _load()
    pairs = [(name, op.covers) for name, op in OPERATORS.items()]
    pairs += [(name, ids) for module in modules for name, ids in module.COVERS.items()]
    found: dict[str, list[str]] = {}
    for name, ids in pairs:
        for item in ids.split():
            found.setdefault(item, []).append(name)
    return found
