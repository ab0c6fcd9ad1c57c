"""All queries, by name."""

from tessera.plans import chat, evidence, graph, layout, library, ops, retrieval, structure
from tessera.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "chat", "evidence", "graph", "layout", "library", "ops", "retrieval", "structure"]
