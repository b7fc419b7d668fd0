"""Money-laundering rules over account histories.

All rules return (transaction_id, rule_name, rule_detail, risk_score).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from finlake.functions.numeric import portable_round
from finlake.operators.ordered import with_next
from finlake.operators.skew import attach

# Rule scores, limits, screened types and country codes.
SCORES = {"structuring": 3, "velocity": 2, "round_dollar": 1, "high_risk_geo": 3, "layering": 3}
REPORTING_LIMIT = 10000.0
HIGH_RISK_COUNTRIES = ("XA", "XB", "XC")
WIRE_TYPES = ("wire", "transfer")
SEQUENCE_TYPES = ("wire", "cash_deposit", "transfer", "ach", "cash_withdrawal")
IN_TYPES = ("wire", "cash_deposit")
OUT_TYPES = ("transfer", "wire", "cash_withdrawal")


def _money(c: Column | str) -> Column:
    return F.concat(F.lit("$"), F.format_number(c, 2))


def _flag(df: DataFrame, rule: str, detail: Column, ids: Column | str = "transaction_id") -> DataFrame:
    return df.select(
        (F.col(ids) if isinstance(ids, str) else ids).alias("transaction_id"),
        F.lit(rule).alias("rule_name"),
        detail.alias("rule_detail"),
        F.lit(SCORES[rule]).alias("risk_score"),
    )


def rule_structuring(tx: DataFrame, limit: float = REPORTING_LIMIT, min_n: int = 2) -> DataFrame:
    """Every deposit of an account-day whose small deposits reach ``limit`` together.

    The day totals are an aggregate (combined map-side) joined back to the
    deposits; a window would put a whole account-day into one task.
    """
    deposits = tx.where((F.col("transaction_type") == "cash_deposit") & (F.col("amount") < limit)).select(
        "transaction_id", "account_id", F.to_date("ts").alias("day"), "amount")
    days = (
        deposits.groupBy("account_id", "day")
        .agg(portable_round(F.sum("amount"), 6).alias("day_total"), F.count(F.lit(1)).alias("n"))
        .where((F.col("day_total") >= limit) & (F.col("n") >= min_n))
        .withColumnRenamed("n", "day_count")
    )
    hits = attach(deposits.drop("amount"), days, ["account_id", "day"])
    detail = F.concat(
        F.col("day_count").cast("string"), F.lit(" cash deposits on "), F.col("day").cast("string"),
        F.lit(" for account "), F.col("account_id"), F.lit(" totalling "), _money("day_total"),
        F.lit(f", each under the ${limit:,.0f} reporting limit"),
    )
    return _flag(hits, "structuring", detail)


def _seconds() -> Column:
    return F.unix_timestamp("ts")


def rule_velocity(tx: DataFrame, seconds: int = 3600, min_n: int = 6) -> DataFrame:
    """Transactions that end a trailing window holding ``min_n`` or more.

    Both window ends count and all rows of one second are peers. Rows are
    first counted per (account, second), so however hot an account is, a
    window task sees at most one row per second of a time block; a block also
    gets the ``seconds`` before it as context.
    """
    keyed = tx.select("transaction_id", "account_id", _seconds().alias("sec"))
    per_second = keyed.groupBy("account_id", "sec").agg(F.count(F.lit(1)).alias("n"))
    block = max(86400, seconds)
    own = F.floor(F.col("sec") / block)
    reach = F.floor((F.col("sec") + seconds) / block)
    blocks = per_second.withColumn("_block", F.explode(F.sequence(own, reach))).withColumn("_own", F.col("_block") == own)
    trailing = Window.partitionBy("account_id", "_block").orderBy("sec").rangeBetween(-seconds, 0)
    busy = (
        blocks.withColumn("tx_count", F.sum("n").over(trailing))
        .where(F.col("_own") & (F.col("tx_count") >= min_n))
        .select("account_id", "sec", "tx_count")
    )
    hits = attach(keyed, busy, ["account_id", "sec"])
    detail = F.concat(
        F.col("tx_count").cast("string"), F.lit(" transactions of account "), F.col("account_id"),
        F.lit(f" within {seconds} seconds"),
    )
    return _flag(hits, "velocity", detail)


def rule_round_dollar(tx: DataFrame, floor: float = 5000.0, modulus: int = 1000) -> DataFrame:
    """Large wires and transfers in whole multiples of ``modulus``."""
    hits = tx.where(
        F.col("transaction_type").isin(*WIRE_TYPES) & (F.col("amount") >= floor) & (F.col("amount") % modulus == 0))
    detail = F.concat(F.lit("Round "), F.col("transaction_type"), F.lit(" of "), _money("amount"))
    return _flag(hits, "round_dollar", detail)


def rule_high_risk_geo(tx: DataFrame, codes: Sequence[str] = HIGH_RISK_COUNTRIES) -> DataFrame:
    """Origin or destination in the list."""
    hits = tx.where(F.col("origin_country").isin(*codes) | F.col("destination_country").isin(*codes))
    detail = F.concat(F.lit("High-risk corridor "), F.col("origin_country"), F.lit(" to "), F.col("destination_country"))
    return _flag(hits, "high_risk_geo", detail)


def rule_layering(tx: DataFrame, hours: float = 3, tol: float = 0.08, floor: float = 3000.0) -> DataFrame:
    """Money in, followed by nearly the same amount out as the account's next movement.

    Card payments are no part of the sequence. Both legs are flagged, so a
    transaction in the middle of a chain appears twice.
    """
    moves = tx.where(F.col("transaction_type").isin(*SEQUENCE_TYPES) & F.col("ts").isNotNull()).select(
        "transaction_id", "account_id", "transaction_type", "amount", _seconds().alias("sec"))
    horizon = int(hours * 3600)
    pairs = with_next(moves, "account_id", "sec", "transaction_id", ("transaction_id", "transaction_type", "amount", "sec"),
                      horizon=horizon)
    gap = F.col("next.sec") - F.col("sec")
    hits = pairs.where(
        F.col("transaction_type").isin(*IN_TYPES)
        & F.col("next.transaction_type").isin(*OUT_TYPES)
        & gap.between(0, horizon)
        & (F.col("amount") > 0)
        & (F.col("amount") >= floor)
        & (F.try_divide(F.abs(F.col("next.amount") - F.col("amount")), F.col("amount")) < tol)
    )
    detail = F.concat(
        _money("amount"), F.lit(" in, "), _money("next.amount"), F.lit(" out after "),
        portable_round(gap / 3600, 1).cast("string"), F.lit("h (account "), F.col("account_id"), F.lit(")"),
    )
    legs = F.explode(F.array(F.col("transaction_id"), F.col("next.transaction_id")))
    return _flag(hits.withColumn("rule_detail", detail).select("rule_detail", legs.alias("leg")), "layering",
                 F.col("rule_detail"), "leg")


def run_rules(tx: DataFrame, structuring: dict | None = None, velocity: dict | None = None,
              round_dollar: dict | None = None, high_risk_geo: dict | None = None,
              layering: dict | None = None) -> DataFrame:
    """All rule outputs in one flag table, duplicates kept.

    ``tx`` is read once per rule: pass a columnar table (see
    ``session.stage_table``) so that each rule scans only its own columns.
    """
    parts = (
        rule_structuring(tx, **(structuring or {})),
        rule_velocity(tx, **(velocity or {})),
        rule_round_dollar(tx, **(round_dollar or {})),
        rule_high_risk_geo(tx, **(high_risk_geo or {})),
        rule_layering(tx, **(layering or {})),
    )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
