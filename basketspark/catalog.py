"""Every query of the library with the SQL of the same result."""

from __future__ import annotations

from .plans import baskets, listings, matches, parsing, prices, streams  # noqa: F401
from .plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
