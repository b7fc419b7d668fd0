"""Batch fraud analysis: rates, misses, rule scorecard, amount screen."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finlake.functions.numeric import pct, portable_round, ratio
from finlake.operators.ordered import global_ntile
from finlake.operators.rules import SCREENED_TYPES, is_emptied, is_large, is_mismatched


def _ints(c: str):
    return F.sum(F.col(c).cast("bigint"))


def fraud_rate(df: DataFrame, by: str = "transaction_type") -> DataFrame:
    """Volume, fraud count, fraud rate and mean amount per group."""
    return (
        df.groupBy(by)
        .agg(
            F.count(F.lit(1)).alias("total_transactions"),
            _ints("is_fraud").alias("fraud_cases"),
            portable_round(F.avg("amount")).alias("avg_transaction_amount"),
        )
        .withColumn("fraud_rate_pct", pct("fraud_cases", "total_transactions"))
        .orderBy(F.desc("fraud_rate_pct"), by)
    )


def miss_rate(df: DataFrame, by: str = "transaction_type") -> DataFrame:
    """Fraud the existing system did not flag, per group."""
    return (
        df.where(F.col("is_fraud") == 1)
        .groupBy(by)
        .agg(F.count(F.lit(1)).alias("total_fraud"), _ints("is_flagged_by_system").alias("caught_by_system"))
        .withColumn("missed_by_system", F.col("total_fraud") - F.col("caught_by_system"))
        .withColumn("miss_rate_pct", pct("missed_by_system", "total_fraud"))
        .orderBy(F.desc("missed_by_system"), by)
    )


def _flags():
    zero = F.lit(False)
    return F.coalesce(is_emptied(), zero), F.coalesce(is_large(), zero), F.coalesce(is_mismatched(), zero)


def rule_scorecard(df: DataFrame, types: Sequence[str] = SCREENED_TYPES) -> DataFrame:
    """Hits per rule, hits of any rule and share of fraud caught, in one pass."""
    emptied, large, mismatch = _flags()
    anyone = emptied | large | mismatch
    return (
        df.where(F.col("transaction_type").isin(*types))
        .agg(
            _ints("is_fraud").alias("actual_fraud"),
            F.count_if(emptied).alias("flagged_by_rule1"),
            F.count_if(large).alias("flagged_by_rule2"),
            F.count_if(mismatch).alias("flagged_by_rule3"),
            F.count_if(anyone).alias("flagged_by_any_rule"),
            F.sum(F.when(anyone, F.col("is_fraud")).otherwise(0).cast("bigint")).alias("_caught"),
        )
        .withColumn("our_detection_rate", pct("_caught", "actual_fraud"))
        .drop("_caught")
    )


def amount_screen(df: DataFrame, percentile: int = 90, mult: float = 2.0,
                  types: Sequence[str] = SCREENED_TYPES) -> DataFrame:
    """Precision of "top amounts and well above average" per type.

    The ratio is rounded to two digits before the test. The percentile comes
    from ``global_ntile``: with two types, a window would use two tasks.
    """
    rows = df.where(F.col("transaction_type").isin(*types)).select("transaction_id", "transaction_type", "amount", "is_fraud")
    # One row per listed type, so the broadcast side is bounded by len(types).
    means = F.broadcast(rows.groupBy("transaction_type").agg(F.avg("amount").alias("_mean")))
    ranked = global_ntile(rows, 100, order=("amount", "transaction_id"), by=("transaction_type",), name="amount_percentile")
    return (
        ranked.where(F.col("amount_percentile") >= percentile)
        .join(means, "transaction_type")
        .where(portable_round(ratio("amount", "_mean")) > mult)
        .groupBy("transaction_type")
        .agg(F.count(F.lit(1)).alias("flagged"), _ints("is_fraud").alias("fraud_caught"))
        .withColumn("precision_pct", pct("fraud_caught", "flagged"))
        .orderBy(F.desc("precision_pct"), "transaction_type")
    )


def sample_types(df: DataFrame, types: Sequence[str] = SCREENED_TYPES, n: int = 5000) -> DataFrame:
    """The first ``n`` rows of the given types by id."""
    return (
        df.where(F.col("transaction_type").isin(*types))
        .orderBy("transaction_id")
        .limit(n)
        .select("transaction_type", "amount", "is_fraud")
    )


def method_comparison(df: DataFrame, types: Sequence[str] = SCREENED_TYPES) -> DataFrame:
    """Fraud caught by the existing system and by the rules, both measured in one pass."""
    emptied, large, mismatch = _flags()
    fraud = F.col("is_fraud") == 1
    ruled = fraud & F.col("transaction_type").isin(*types) & (emptied | large | mismatch)
    totals = df.agg(
        F.count_if(fraud).alias("fraud"),
        F.count_if(fraud & (F.col("is_flagged_by_system") == 1)).alias("system"),
        F.count_if(ruled).alias("rules"),
    )
    rows = F.array(*[
        F.struct(F.lit(label).alias("method"), F.col(c).alias("fraud_caught"), pct(c, "fraud").alias("detection_rate"))
        for label, c in (("Original System", "system"), ("Rule Set", "rules"))
    ])
    return totals.select(F.explode(rows).alias("r")).select("r.*")


def reconcile(tables: dict[str, DataFrame]) -> DataFrame:
    """Row and fraud count per named table."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("total_rows"), _ints("is_fraud").alias("fraud_cases")).select(
            F.lit(name).alias("dataset"), "total_rows", "fraud_cases")
        for name, df in tables.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def alerts_per_rule(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("rule_triggered").agg(F.count(F.lit(1)).alias("alerts"))


def sink_latency(alerts: DataFrame) -> DataFrame:
    """Mean and largest seconds between detection and storage per rule."""
    lag = F.unix_micros("created_at") - F.unix_micros("detected_at")
    return (
        alerts.withColumn("_lag", lag)
        .groupBy("rule_triggered")
        .agg(
            F.count(F.lit(1)).alias("alerts"),
            portable_round(F.try_divide(F.sum("_lag").cast("double"), F.count("_lag").cast("double")) / 1e6, 3).alias("avg_seconds"),
            portable_round(F.max("_lag") / 1e6, 3).alias("max_seconds"),
        )
    )


