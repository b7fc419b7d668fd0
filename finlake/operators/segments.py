"""Marketing response and credit-card segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finlake.functions.bands import DORMANT_DAYS, dormancy, marketing_age_band, util_band
from finlake.functions.numeric import pct, portable_round, ratio
from finlake.operators.ordered import global_ntile

# Profit proxy coefficients.
APR = 0.8
INTERCHANGE = 0.015


def responded() -> Column:
    return F.lower("y") == "yes"


def rate(df: DataFrame, pred: Column | None = None, by: Column | None = None, total: str = "total",
         hits: str = "responders", share: str = "response_pct") -> DataFrame:
    """Rows, rows meeting ``pred`` and their percentage, overall or per group."""
    test = responded() if pred is None else pred
    grouped = df.groupBy(by) if by is not None else df.groupBy()
    return grouped.agg(F.count(F.lit(1)).alias(total), F.count_if(test).alias(hits)).withColumn(share, pct(hits, total))


def response_by_job(df: DataFrame, k: int = 10) -> DataFrame:
    return rate(df, by=F.lower("job").alias("job")).orderBy(F.desc("response_pct"), "job").limit(k)


def dormancy_summary(df: DataFrame) -> DataFrame:
    """Contacts never reached before (the sentinel) against the others."""
    return (
        df.agg(
            F.count_if(F.col("pdays") == DORMANT_DAYS).alias("dormant_customers"),
            F.count_if(F.col("pdays") != DORMANT_DAYS).alias("active_customers"),
            F.count(F.lit(1)).alias("_all"),
        )
        .withColumn("dormant_pct", pct("dormant_customers", "_all"))
        .drop("_all")
    )


def response_by_dormancy(df: DataFrame) -> DataFrame:
    return rate(df, by=dormancy().alias("segment"), total="customers")


def response_by_age(df: DataFrame) -> DataFrame:
    return rate(df, by=marketing_age_band().alias("age_band"), total="customers", share="response_rate").drop("responders")


def card_enriched(df: DataFrame, apr: float = APR, interchange: float = INTERCHANGE) -> DataFrame:
    """One row per card with utilisation and a profit proxy; a zero limit gives null utilisation."""
    return df.select(
        "cust_id", "balance", "purchases", "cash_advance", "credit_limit", "tenure",
        portable_round(ratio("balance", "credit_limit"), 3).alias("util_ratio"),
        portable_round(F.col("balance") * F.lit(apr) + F.col("purchases") * F.lit(interchange)).alias("annual_profit"),
        "prc_full_payment",
    )


def profit_by(cards: DataFrame, by: Column | str, name: str) -> DataFrame:
    """Customers, mean profit and mean utilisation per group of the enriched cards."""
    key = F.col(by) if isinstance(by, str) else by
    return cards.groupBy(key.alias(name)).agg(
        F.count(F.lit(1)).alias("customers"),
        portable_round(F.avg("annual_profit")).alias("avg_profit"),
        portable_round(F.avg("util_ratio") * 100).alias("avg_util_pct"),
    )


def profit_by_tenure(cards: DataFrame) -> DataFrame:
    return profit_by(cards, "tenure", "tenure").orderBy("tenure")


def profit_by_util(cards: DataFrame) -> DataFrame:
    return profit_by(cards, util_band(), "util_band").drop("avg_util_pct")


def extreme_segments(cards: DataFrame, col: str = "annual_profit", k: int = 20, row_id: str = "cust_id") -> DataFrame:
    """Mean profit and utilisation of the top and the bottom of ``k`` equal parts."""
    parts = global_ntile(cards.select(row_id, col, "util_ratio"), k, order=(col, row_id), name="part")
    share = f"{100 / k:g} %"
    label = F.when(F.col("part") == k, f"Top {share}").otherwise(f"Bottom {share}")
    return profit_by(parts.where(F.col("part").isin(1, k)).withColumnRenamed(col, "annual_profit"), label, "segment")


def spend_vs_payment(df: DataFrame, n: int = 200) -> DataFrame:
    """Spend, payments and whether more was paid than spent, for the first ``n`` customers."""
    return df.orderBy("cust_id").limit(n).select(
        F.col("purchases").alias("total_spend"),
        F.col("payments").alias("total_payments"),
        (F.col("payments") > F.col("purchases")).cast("int").alias("overpay_flag"),
    )
