"""Imports every query module, so that the registry is full."""

from __future__ import annotations

from checks import group_queries, motion_queries, scalar_queries, track_queries  # noqa: F401
from checks.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
