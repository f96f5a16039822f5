"""Registered queries of the library's own operators and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from lodestar.plans import curation_queries, item_queries, log_queries, rank_queries  # noqa: F401  each registers its queries
from lodestar.plans.tables import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
