"""Queries over the fixture tables."""

from . import catalogue, changes, checks, compaction, documents, drift, graphs, groups, inferred, records, reports, stores, streams, text, tokens, units  # noqa: F401  they register their queries
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
