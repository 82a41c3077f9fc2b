"""All queries of the library and their SQL."""

from . import comparisons, queries, record_queries, texts  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
