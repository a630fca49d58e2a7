"""All registered queries: importing the modules registers them."""

from netlattice.plans import header_queries, path_queries, queries, rule_queries  # noqa: F401
from netlattice.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
