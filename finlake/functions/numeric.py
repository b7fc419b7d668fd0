"""Rounding and ratios."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def portable_round(c: Column | str, digits: int = 2) -> Column:
    """Round half away from zero with plain double arithmetic.

    ``round`` on a double goes through decimal text in Spark and gives other
    answers on halves elsewhere; this form is equal in every engine. A half
    that a sum of doubles missed by its rounding errors still counts as one,
    so a mean does not depend on the order of its partial sums. Values too
    large to have such digits are returned as they are.
    """
    x = _col(c).cast("double")
    scaled = F.abs(x) * F.lit(float(10**digits))
    up = F.floor(scaled + F.lit(0.5) + F.lit(1e-9) + scaled * F.lit(1e-12))
    return F.when(scaled < F.lit(2.0**52), F.signum(x) * up / F.lit(float(10**digits)) + F.lit(0.0)).otherwise(x)


def rounded(df: DataFrame, columns: Sequence[str], digits: int = 4) -> DataFrame:
    """``df`` with the last digits of computed ``columns`` cut, where results of two engines are compared."""
    return df.withColumns({c: portable_round(c, digits) for c in columns})


def ratio(num: Column | str, den: Column | str) -> Column:
    """``num / den`` as double, null where the denominator is zero."""
    return F.try_divide(_col(num).cast("double"), _col(den).cast("double"))


def pct(num: Column | str, den: Column | str, digits: int = 2) -> Column:
    """``num`` as a rounded percentage of ``den``, null on zero."""
    return portable_round(F.try_divide(_col(num).cast("double") * F.lit(100.0), _col(den).cast("double")), digits)
