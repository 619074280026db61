"""All queries outside of the optional subpackage: importing this registers them."""

from __future__ import annotations

from lodestack.plans import ingestion, timing  # noqa: F401
from lodestack.plans.catalogue import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
