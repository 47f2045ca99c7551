"""All registered queries of the relational engine."""

from __future__ import annotations

from weft.functions import scalar, user
from weft.operators import aggregate, combine, filters, join, ranges, recursion, window
from weft.plans.catalog import ORACLE_SQL, QUERIES
from weft.sources import queries as sources
from weft.streaming import batch
from weft.streaming import queries as streams

__all__ = ["ORACLE_SQL", "QUERIES", "aggregate", "batch", "combine", "filters", "join", "ranges", "recursion", "scalar", "sources", "streams", "user", "window"]
