"""Registered queries over the given tables, each with the SQL it must equal where there is one."""

from seriesloom.catalog import diagnosis, forecasting, recall, sources, twins  # noqa: F401  (register their queries)
from seriesloom.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
