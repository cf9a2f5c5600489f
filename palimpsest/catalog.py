"""All queries of the package by name, with the SQL that they equal."""

from __future__ import annotations

from .plans import build, code, context, coupling, documents, evidence, graphs, investigation, names, people, relational, tables, temporal  # noqa: F401  they register
from .plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
