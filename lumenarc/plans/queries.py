"""Registered queries over the driver tables and their SQL counterparts."""

from lumenarc.plans import q_functions, q_joins, q_search, q_sources, q_updates  # noqa: F401
from lumenarc.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
