"""Order-dependent operators that stay parallel on any key distribution.

A window without partition, or with a hot partition key, runs in one task.
The three operators here give the same exact results with bounded tasks:

* ``global_ntile`` sorts by range over all tasks and adds per-slice offsets;
* ``exact_quantiles`` finds the value at a rank through ranges of values;
* ``with_next`` cuts each key into time slices and hands every slice the first
  row of the following one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from finlake.session import materialise

_SLICE_BITS = 33


def positions(df: DataFrame, order: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Exact zero-based position ``_pos`` and group size ``_size`` of every row.

    Rows are range-partitioned by (by, order), so a hot group or a hot value
    is split over many tasks as long as ``order`` ends in a unique column.
    After the sort ``monotonically_increasing_id`` is the slice number and the
    row number inside it; the slices are fixed by a reliable checkpoint before
    they are read twice.
    """
    by, order = list(by), list(order)
    ordered = materialise(
        df.repartitionByRange(*by, *order)
        .sortWithinPartitions(*by, *order)
        .withColumn("_row", F.monotonically_increasing_id())
        .withColumn("_slice", F.shiftright("_row", _SLICE_BITS))
    )
    # One row per (group, slice): adaptive execution sees its size and broadcasts it if it may.
    slices = ordered.groupBy(*by, "_slice").agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    group = Window.partitionBy(*[F.col(c) for c in by]) if by else Window.partitionBy(F.lit(0))
    before = group.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = materialise(
        slices.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .withColumn("_size", F.sum("_n").over(group))
        .drop("_n")
    )
    left, right = ordered.alias("l"), slices.alias("r")
    same = F.col("l._slice") == F.col("r._slice")
    for c in by:
        same = same & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    return left.join(right, same).select(
        *[F.col(f"l.{c}") for c in df.columns],
        (F.col("_before") + F.col("_row") - F.col("_first")).alias("_pos"),
        F.col("_size"),
    )


def global_ntile(df: DataFrame, k: int, order: Sequence[str], by: Sequence[str] = (), name: str = "ntile") -> DataFrame:
    """``NTILE(k)`` over (partition by ``by`` order by ``order``).

    The first ``size % k`` buckets hold one row more. Ascending order, nulls
    first; end ``order`` with a unique column to break ties.
    """
    short = F.expr(f"_size div {k}")
    extra = F.col("_size") % k
    big = extra * (short + 1)
    bucket = F.when(F.col("_pos") < big, F.expr(f"_pos div (_size div {k} + 1)") + 1).otherwise(
        extra + F.floor((F.col("_pos") - big) / F.greatest(short, F.lit(1))) + 1
    )
    return positions(df, order, by).withColumn(name, bucket.cast("int")).drop("_pos", "_size")


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """Exact interpolated quantiles per non-null key: columns keys, ``prob``, ``quantile``, ``n``.

    An exact percentile aggregate keeps all distinct values of a key in one
    buffer. Here values are counted per (key, value) and range-partitioned by
    both, so a slice holds its even share of the values, whatever the key or
    their spread. A running count over the slices of a key finds the slice of
    each wanted rank, and only those are looked at value by value.
    """
    keys = list(keys)
    v = F.col(value)
    present = v.isNotNull() & ~F.isnan(v.cast("double"))
    for k in keys:
        present = present & F.col(k).isNotNull()
    counts = materialise(
        df.where(present)
        .groupBy(*keys, v.cast("double").alias("_v"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .repartitionByRange(*keys, "_v")
        .withColumn("_b", F.spark_partition_id())
    )
    per_key = Window.partitionBy(*keys)
    buckets = (
        counts.groupBy(*keys, "_b")
        .agg(F.sum("_n").alias("_bn"))
        .withColumn("_size", F.sum("_bn").over(per_key))
        .withColumn("_cum", F.sum("_bn").over(per_key.orderBy("_b")) - F.col("_bn"))
    )

    def wanted(start, length):
        ranks = F.array(*[
            F.struct(F.lit(float(p)).alias("prob"), F.lit(side).alias("side"),
                     fn((F.col("_size") - 1) * F.lit(float(p))).alias("rank"))
            for p in probs for side, fn in (("lo", F.floor), ("hi", F.ceil))
        ])
        return F.filter(ranks, lambda r: (r["rank"] >= start) & (r["rank"] < start + length))

    hit = buckets.where(F.size(wanted(F.col("_cum"), F.col("_bn"))) > 0).select(*keys, "_b", "_size", "_cum")
    inside = Window.partitionBy(*keys, "_b").orderBy("_v")
    found = (
        counts.join(hit, [*keys, "_b"])
        .withColumn("_start", F.col("_cum") + F.sum("_n").over(inside) - F.col("_n"))
        .select(*keys, "_v", "_size", F.explode(wanted(F.col("_start"), F.col("_n"))).alias("_w"))
    )
    lo = F.max(F.when(F.col("_w.side") == "lo", F.col("_v")))
    hi = F.max(F.when(F.col("_w.side") == "hi", F.col("_v")))
    frac = (F.max("_size") - 1) * F.col("prob") - F.floor((F.max("_size") - 1) * F.col("prob"))
    return found.groupBy(*keys, F.col("_w.prob").alias("prob")).agg(
        (lo + (hi - lo) * frac).alias("quantile"), F.max("_size").alias("n")
    )


def exact_median(df: DataFrame, keys: Sequence[str], value: str, name: str = "median") -> DataFrame:
    """Exact median and row count ``n`` per key."""
    q = exact_quantiles(df, keys, value, (0.5,))
    return q.select(*keys, F.col("quantile").alias(name), "n")


def with_next(df: DataFrame, key: str, seconds: str, tiebreak: str, cols: Sequence[str], horizon: int,
              slice_seconds: int = 60, name: str = "next") -> DataFrame:
    """Attach the following row of the same key, as struct ``next`` of ``cols``.

    Exact for following rows at most ``horizon`` seconds away; farther ones
    may be null. Ordering is (``seconds``, ``tiebreak``).

    Each key is cut into slices of ``slice_seconds``, whatever its number of
    rows. The first row of a slice is handed to the slice before it as a
    context row, so a single window over (key, slice) sees every neighbour;
    what meets in one task is bounded by the calendar, not by the key.
    """
    span = max(86400, horizon)
    sliced = df.withColumn("_slice", F.floor(F.col(seconds) / slice_seconds) * slice_seconds)
    row = F.struct(F.col(seconds).alias("_s"), F.col(tiebreak).alias("_t"), F.struct(*cols).alias("_c"))
    heads = sliced.groupBy(key, "_slice").agg(F.min(row).alias("_head"))
    heads = heads.withColumn("_span", (F.floor(F.col("_slice") / span) * span))
    # First head of each span, shown to the span before it.
    first = heads.groupBy(key, "_span").agg(F.min("_head").alias("_head")).withColumn("_span", F.col("_span") - span)
    shown = heads.select(key, "_span", "_slice", "_head").unionByName(
        first.select(key, "_span", F.lit(None).cast("bigint").alias("_slice"), "_head")
    )
    following = F.lead("_head").over(Window.partitionBy(key, "_span").orderBy("_head"))
    context = (
        shown.withColumn("_next", following)
        .where(F.col("_slice").isNotNull() & F.col("_next").isNotNull())
        .select(key, "_slice", F.col("_next").alias("_row"))
    )
    rows = sliced.select("*", row.alias("_row")).unionByName(context, allowMissingColumns=True)
    order = Window.partitionBy(key, "_slice").orderBy("_row._s", "_row._t")
    return (
        rows.withColumn(name, F.lead("_row._c").over(order))
        .where(F.col(seconds).isNotNull())
        .drop("_slice", "_row")
    )
