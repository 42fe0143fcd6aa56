"""All registered queries of the observation operators and their SQL."""

from __future__ import annotations

from swathkit.plans import q_aggregates, q_audits, q_composites, q_filters, q_grid, q_joins, q_scalars, q_sets, q_sources, q_statistics, q_windows  # noqa: F401
from swathkit.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
