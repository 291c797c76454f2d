"""All queries and their SQL."""

from tonefold.plans import analysis, records, searches, stored  # noqa: F401  they register their queries
from tonefold.plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
