"""All registered queries."""

from lodestar.plans import (  # noqa: F401
    aggregate_queries,
    feature_queries,
    model_queries,
    network_queries,
    panel_queries,
    relational_queries,
    scalar_queries,
    source_queries,
    sql_queries,
    stream_queries,
    window_queries,
)
from lodestar.plans.registry import COVERS, ORACLES, QUERIES

__all__ = ["COVERS", "ORACLES", "QUERIES"]
