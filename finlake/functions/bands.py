"""Threshold bands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cut points and labels of the customer bands.
WEALTH_CUTS = ((500000, "Ultra High Net Worth"), (100000, "High Net Worth"), (50000, "Affluent"), (10000, "Mass Market"))
WEALTH_DEFAULT = "Low Wealth"
AGE_CUTS = ((30, "Under 30"), (40, "30s"), (50, "40s"), (60, "50s"))
AGE_DEFAULT = "60+"
CREDIT_CUTS = ((800, "Excellent"), (700, "Good"), (600, "Fair"))
CREDIT_DEFAULT = "Poor"
MARKETING_AGE_CUTS = ((30, "<30"), (45, "30-44"), (60, "45-59"))
MARKETING_AGE_DEFAULT = "60+"
UTIL_CUTS = ((0.25, "<25 %"), (0.50, "25-49 %"), (0.75, "50-74 %"))
UTIL_DEFAULT = "75 %+"
DORMANT_DAYS = 999


def band(col: Column | str, cuts: Sequence[tuple[float, str]], default: str, side: str = "below") -> Column:
    """Label ``col`` with the first cut it satisfies.

    ``side="below"`` tests ``col < cut``, ``side="from"`` tests ``col >= cut``.
    Null compares to nothing and therefore gets the default label.
    """
    value = F.col(col) if isinstance(col, str) else col
    expr = None
    for cut, label in cuts:
        test = value < F.lit(cut) if side == "below" else value >= F.lit(cut)
        expr = F.when(test, F.lit(label)) if expr is None else expr.when(test, F.lit(label))
    return expr.otherwise(F.lit(default))


def wealth_tier(col: Column | str = "Net_Assets") -> Column:
    return band(col, WEALTH_CUTS, WEALTH_DEFAULT, side="from")


def age_group(col: Column | str = "Age") -> Column:
    return band(col, AGE_CUTS, AGE_DEFAULT)


def credit_band(col: Column | str = "CreditScore") -> Column:
    return band(col, CREDIT_CUTS, CREDIT_DEFAULT, side="from")


def marketing_age_band(col: Column | str = "age") -> Column:
    """Whole-number ages, so ``< 45`` is the same as ``between 30 and 44``."""
    return band(col, MARKETING_AGE_CUTS, MARKETING_AGE_DEFAULT)


def util_band(col: Column | str = "util_ratio") -> Column:
    return band(col, UTIL_CUTS, UTIL_DEFAULT)


def dormancy(col: Column | str = "pdays") -> Column:
    value = F.col(col) if isinstance(col, str) else col
    return F.when(value == DORMANT_DAYS, "Dormant").otherwise("Active")
