"""Operators for large text corpora and their registered queries; nothing else in the library imports this package."""

from tallyward.llm.queries import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
