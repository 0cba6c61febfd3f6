"""Queries over the given tables, one module per area."""

from plumbline.workloads import drift, models, operations, quality, streams  # noqa: F401
from plumbline.workloads.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
