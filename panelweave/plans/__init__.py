"""Registered queries: the operators run on the driver's tables, with equivalent SQL."""

from panelweave.plans import (  # noqa: F401
    area_queries,
    curve_queries,
    join_queries,
    pair_queries,
    pooling_queries,
    report_queries,
    source_queries,
    spatial_queries,
    sweep_queries,
    table_queries,
    trend_queries,
)
from panelweave.plans.registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
