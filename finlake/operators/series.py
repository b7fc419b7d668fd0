"""Price series: monthly alignment, ratios, rankings, coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from finlake.functions.numeric import pct, portable_round, ratio


def to_monthly(df: DataFrame) -> DataFrame:
    """Mean price per series and calendar month."""
    return df.groupBy("metal", F.trunc("date", "MM").alias("month")).agg(F.avg("price").alias("price"))


def yearly_avg(df: DataFrame) -> DataFrame:
    return df.groupBy("metal", F.year("date").alias("year")).agg(
        portable_round(F.avg("price")).alias("avg_price"))


def date_slice(df: DataFrame, lo: str, hi: str, col: str = "date") -> DataFrame:
    """Rows between two dates, both included."""
    return df.where(F.col(col).between(F.lit(lo).cast("date"), F.lit(hi).cast("date")))


def merge_feeds(feeds: Sequence[tuple[DataFrame, str, int]]) -> DataFrame:
    """Monthly series from overlapping feeds of any frequency.

    ``feeds`` holds (frame with date and price, metal, priority); where months
    overlap the feed with the higher priority wins.
    """
    parts = [
        df.select(F.lit(metal).alias("metal"), "date", "price", F.lit(priority).alias("priority"))
        for df, metal, priority in feeds
    ]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    monthly = union.groupBy("metal", F.trunc("date", "MM").alias("month"), "priority").agg(F.avg("price").alias("price"))
    return monthly.groupBy("metal", "month").agg(
        F.max_by("price", "priority").alias("price"), F.max("priority").alias("priority"))


def price_ratio(df: DataFrame, num: str = "Gold", den: str = "Silver") -> DataFrame:
    """Both series side by side per month with their ratio; null where one is missing.

    The two series are columns of one aggregate, so aligning them needs no join.
    """
    by_series = [F.avg(F.when(F.col("metal") == m, F.col("price"))).alias(f"_{i}") for i, m in enumerate((num, den))]
    return (
        df.where(F.col("metal").isin(num, den))
        .groupBy(F.trunc("date", "MM").alias("month"))
        .agg(*by_series)
        .select("month", portable_round("_0").alias(num.lower()), portable_round("_1").alias(den.lower()),
                portable_round(ratio("_0", "_1"), 4).alias("ratio"))
    )


def extreme_ratios(df: DataFrame, n: int = 10, num: str = "Gold", den: str = "Silver") -> DataFrame:
    """The ``n`` months with the highest ratio."""
    return price_ratio(df, num, den).where(F.col("ratio").isNotNull()).orderBy(F.desc("ratio"), "month").limit(n)


def topn_periods(df: DataFrame, n: int, ties: bool = True, value: str = "avg_price", by: str = "metal",
                 period: str = "year") -> DataFrame:
    """Best and worst ``n`` periods per series; ``ties`` keeps equals of the last place.

    ``df`` has one row per series and period, so a window sees a calendar at most.
    """
    def ranked(order, label):
        w = Window.partitionBy(by).orderBy(order, *([] if ties else [period]))
        place = F.rank() if ties else F.row_number()
        return df.withColumn("place", place.over(w)).where(F.col("place") <= n).withColumn("side", F.lit(label))

    return ranked(F.desc(value), "best").unionByName(ranked(F.asc(value), "worst"))


def yearly_change(df: DataFrame) -> DataFrame:
    """Year average against the year before on record, per series."""
    w = Window.partitionBy("metal").orderBy("year")
    yearly = yearly_avg(df).withColumn("prev_price", F.lag("avg_price").over(w))
    return yearly.withColumn("change_pct", pct(F.col("avg_price") - F.col("prev_price"), "prev_price"))


def monthly_change(df: DataFrame) -> DataFrame:
    """Month average against the month before on record, per series."""
    w = Window.partitionBy("metal").orderBy("month")
    monthly = to_monthly(df).withColumn("price", portable_round("price")).withColumn("prev_price", F.lag("price").over(w))
    return monthly.withColumn("change_pct", pct(F.col("price") - F.col("prev_price"), "prev_price"))


def series_coverage(df: DataFrame) -> DataFrame:
    """First and last month, months present and months missing per series, within the range of all series."""
    months = df.groupBy("metal", F.trunc("date", "MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    span = months.agg(F.min("month").alias("lo"), F.max("month").alias("hi"))
    per = months.groupBy("metal").agg(
        F.min("month").alias("first_month"), F.max("month").alias("last_month"), F.count(F.lit(1)).alias("months_present"))
    total = (F.months_between(span.select("hi").scalar(), span.select("lo").scalar()) + 1).cast("bigint")
    return per.withColumn("months_missing", total - F.col("months_present"))


def missing_months(df: DataFrame) -> DataFrame:
    """Months of the common calendar a series has no price for."""
    months = df.groupBy("metal", F.trunc("date", "MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    span = months.agg(F.min("month").alias("lo"), F.max("month").alias("hi"))
    calendar = months.select("metal").distinct().withColumn(
        "month", F.explode(F.sequence(span.select("lo").scalar(), span.select("hi").scalar(), F.expr("interval 1 month"))))
    return calendar.join(months, ["metal", "month"], "left_anti")
