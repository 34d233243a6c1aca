"""Queries of the radar operators over the driver's tables, with the SQL that gives the same rows."""

from . import measure, scenes, store, text, vector, watch  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
