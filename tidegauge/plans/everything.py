"""Registered queries: each family module fills the registry with a Spark query and, where SQL can
express it on whole tables, the equivalent SQL."""

from tidegauge.plans import (  # noqa: F401
    accuracy, analysis, ensembles, forecasts, grids, ingest, live, policy, scalars, series, streams,
)
from tidegauge.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
