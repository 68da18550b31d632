"""All named queries of the library outside the training-data subpackage."""

from __future__ import annotations

from lexmill.plans import analysis, articles, events, judging, quality, retrieval, search, structure, text, warehouse  # noqa: F401  they register their queries
from lexmill.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
