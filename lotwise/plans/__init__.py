"""Queries over the supplied tables, by area, and the SQL that each is held against."""

from . import analytics, lake, market, measured, search, streams
from .views import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "analytics", "lake", "market", "measured", "search", "streams"]
