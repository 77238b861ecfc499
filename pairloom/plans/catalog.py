"""All registered queries of the library itself."""

from __future__ import annotations

from pairloom.plans import files, pairing, reporting  # noqa: F401  they register themselves
from pairloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
