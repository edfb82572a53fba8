"""Queries by name, with the SQL that gives the same rows."""

from __future__ import annotations

from .plans import consensus_queries, growth_queries, text_queries, time_queries, vector_queries  # noqa: F401  they register themselves
from .plans.base import ORACLES, QUERIES

FLAGSHIP = "emergent"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
