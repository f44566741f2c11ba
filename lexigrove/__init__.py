"""Lexigrove: corpus-graph retrieval, upkeep and evaluation as PySpark DataFrame plans."""

__version__ = "0.1.0"
