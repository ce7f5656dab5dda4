"""Registered queries, one module per family."""

from . import cross, outcomes, streams, studies, upkeep, windows  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
