"""The registered queries and their oracle SQL, by area."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

AREAS = ("profiling", "metrics", "statistics", "joins", "governance", "sessions", "personal_data", "verification", "questions")


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every query by name."""
    found: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for area in AREAS:
        found |= import_module(f"workload.{area}").QUERIES
    return found


def all_oracles() -> dict[str, str]:
    """The oracle SQL of every query that has one."""
    found: dict[str, str] = {}
    for area in AREAS:
        found |= import_module(f"workload.{area}").ORACLES
    return found
