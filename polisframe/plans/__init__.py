"""Registered queries over the derived city model, each with an independent SQL statement where one is possible."""

from polisframe.plans import changes, files, hierarchies, loads, queries, removals, spatials, statistics, tilings  # noqa: F401
from polisframe.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
