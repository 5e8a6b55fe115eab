"""Registered queries over the driver's tables."""

from . import graph_queries, load_queries, relational_queries, rule_queries, search_queries  # noqa: F401
from .registry import QUERIES

__all__ = ["QUERIES"]
