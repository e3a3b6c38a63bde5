"""Point-cloud structure analytics as Spark DataFrame jobs."""

from .params import SegParams, depth_rows

__all__ = ["SegParams", "depth_rows"]
