"""Queries over the given tables, and their SQL."""

from __future__ import annotations

from . import graph_queries, measure_queries, record_queries, run_queries, search_queries, turn_queries
from .registry import QUERIES, SQL
from .search_queries import flagship

__all__ = ["QUERIES", "SQL", "flagship", "graph_queries", "measure_queries", "record_queries", "run_queries", "search_queries", "turn_queries"]
