"""All queries of the library by name, and the SQL that gives the same rows."""

from __future__ import annotations

from stratacube.plans import q_composite, q_geometry, q_ingest, q_plans, q_products, q_pyramid, q_rules, q_select, q_series, q_store, q_temporal, q_values  # noqa: F401
from stratacube.plans.base import ORACLE, QUERIES

FLAGSHIP = "water_by_time"

__all__ = ["FLAGSHIP", "ORACLE", "QUERIES"]
