"""Loads every query module, so that the registry is complete."""

from threadline.plans import (  # noqa: F401
    case_queries,
    extension_queries,
    graph_queries,
    source_queries,
    stream_queries,
    text_queries,
)
from threadline.plans.registry import all_queries, all_sql

__all__ = ["all_queries", "all_sql"]
