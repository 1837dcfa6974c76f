"""All registered queries."""

from __future__ import annotations

from seriesloom.plans import backtesting, cleaning, connectors, diagnostics, modelling, rules, texts  # noqa: F401
from seriesloom.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
