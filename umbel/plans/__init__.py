"""Registered queries, each with the DuckDB text of the same result where SQL can say it."""

from __future__ import annotations

from umbel.plans import catalogue, evaluation, geometric, quantised, ranked, regional, relational, streams, vectors  # noqa: F401  registers
from umbel.plans.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
