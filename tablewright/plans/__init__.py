"""Registered queries over the given tables, each with its SQL twin where one exists."""

from __future__ import annotations

from tablewright.plans.registry import ORACLES, QUERIES
from tablewright.plans import advice, catalogue, learning, profiling  # noqa: F401  (registers)

__all__ = ["ORACLES", "QUERIES"]
