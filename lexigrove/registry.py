"""Every query of the core and its equivalent SQL."""

from __future__ import annotations

import importlib

MODULES = [
    "lexigrove.operators.references", "lexigrove.functions.text", "lexigrove.operators.lexical", "lexigrove.operators.fusion",
    "lexigrove.operators.vectors", "lexigrove.operators.evaluation", "lexigrove.operators.graph", "lexigrove.operators.chunking",
    "lexigrove.operators.extraction", "lexigrove.operators.profiles", "lexigrove.operators.incremental",
    "lexigrove.operators.quality", "lexigrove.operators.retrieval", "lexigrove.operators.reports",
]


def all_queries() -> dict:
    return {name: f for m in MODULES for name, f in importlib.import_module(m).QUERIES.items()}


def all_oracles() -> dict:
    return {name: sql for m in MODULES for name, sql in importlib.import_module(m).ORACLES.items()}
