"""Registered queries with the SQL that must give the same rows."""

from weftline.catalog import (  # noqa: F401
    groups,
    indicators,
    models,
    relations,
    reshape,
    rows,
    series,
    sources,
    statistics,
    text,
)
from weftline.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
