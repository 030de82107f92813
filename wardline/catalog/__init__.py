"""Named queries over the provided tables, each with its DuckDB oracle where SQL can express it."""

from wardline.catalog import alerts, changes, conform, eda, metrics, ml, more, plan_queries, prep, stream, tables  # noqa: F401  (registers queries)
from wardline.catalog.registry import ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE"]
