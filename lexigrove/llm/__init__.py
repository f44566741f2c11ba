"""Operators on training text. Nothing else in the package imports this one."""

from lexigrove.llm import leakage, ledger, mixing, pairs, scans, spans, splitting

_MODULES = [scans, splitting, ledger, pairs, leakage, mixing, spans]
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
