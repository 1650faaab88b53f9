"""Registered queries over the driver's tables and their SQL."""

from weftlink.plans.queries import entry_query, queries
from weftlink.plans.sql import oracle_sql

__all__ = ["entry_query", "oracle_sql", "queries"]
