"""Whole queries over the test tables, each with the SQL that says the same."""

from . import further  # noqa: F401  registers its plans
from .relational import PLANS, oracle_sql, queries

__all__ = ["PLANS", "oracle_sql", "queries"]
