"""Registry of the core queries and their SQL."""

from __future__ import annotations

import importlib

from arbolith.plans.registry import Plans, Query

#: Modules with a ``plans`` registry.
MODULES = (
    "advantages", "hierarchies", "preferences", "texts", "evaluations", "samples", "trees", "chats", "sources", "streams", "extras", "selections"
)


def _registries() -> list[Plans]:
    return [importlib.import_module(f"arbolith.plans.{m}").plans for m in MODULES]


def queries() -> dict[str, Query]:
    return {k: q for p in _registries() for k, q in p.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for p in _registries() for k, q in p.sql.items()}
