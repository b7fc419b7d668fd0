"""Joins of per-key results back to the rows.

One account, customer or day may hold a large part of all rows. Aggregates
combine map-side. The join back hashes the rows of a hot key to one task,
which adaptive execution splits: both sides come straight from a shuffle, and
nothing behind the join needs the key's rows together before the next one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach(rows: DataFrame, lookup: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join per-key results to ``rows``; ``lookup`` has one row per key.

    Rows with a null key match nothing. In a left join they stay out of the
    shuffle, where they would all meet in one task, and are put back with nulls.
    """
    keys = list(keys)
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    joined = rows.where(known).join(lookup.where(known), keys, how)
    if how != "left":
        return joined
    return joined.unionByName(rows.where(~known), allowMissingColumns=True)
