"""Registered queries and their SQL."""

from tracksmith.plans import io_queries, track_queries  # noqa: F401  (register their queries)
from tracksmith.plans.queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
