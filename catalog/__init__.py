"""All registered queries; importing a section registers its queries."""

from catalog import columns, counts, distances, fairness, independence, intake, privacy, repairs, synthesis  # noqa: F401
from catalog.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
