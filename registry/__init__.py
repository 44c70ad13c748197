"""Registered queries: each operator on the given tables, with its SQL twin where one exists."""

from registry import declared, dense, graphs, scalars, tables, texts, vector_rules
from registry.common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "declared", "dense", "graphs", "scalars", "tables", "texts", "vector_rules"]
