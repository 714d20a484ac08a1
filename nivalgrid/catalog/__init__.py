"""Named queries over the driver tables, each with its SQL counterpart."""

from __future__ import annotations

from . import aggregates, analyses, columns, joins, sources, windows  # noqa: F401  (registration)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
