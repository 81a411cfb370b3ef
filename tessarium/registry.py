"""Registered queries and their SQL."""

from tessarium.plans import collection, details  # noqa: F401
from tessarium.plans.queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
