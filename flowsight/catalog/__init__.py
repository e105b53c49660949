"""Registered queries and their DuckDB twins."""

from . import flow_queries, model_queries, report_queries, stream_queries  # noqa: F401
from .registry import REGISTRY

__all__ = ["REGISTRY"]
