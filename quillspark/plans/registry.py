"""Queries by name and their SQL, for the driver."""

from __future__ import annotations

from .queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
