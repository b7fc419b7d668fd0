"""Imports every query module, so that the registry is complete."""

from finlake.plans import aml, cards, documents, fraud, lake, metals, patrol, revenue, wealth  # noqa: F401
from finlake.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
