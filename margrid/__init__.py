"""Spark operators for private, constraint-aware categorical tables."""

from margrid.domain import Constraint, Domain

__all__ = ["Constraint", "Domain"]
