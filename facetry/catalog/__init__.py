"""Queries over the driver's tables, one or more per operator."""

from . import basic_queries, octree_queries, quality_queries, structure_queries, vote_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
