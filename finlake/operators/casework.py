"""Review queue, case files and decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from finlake.operators.quality import clean_transactions
from finlake.operators.screening import run_rules
from finlake.session import stage_table

# Allowed review outcomes.
OUTCOMES = ("cleared", "escalated", "confirmed_sar")


def undecided(flags: DataFrame, decisions: DataFrame) -> DataFrame:
    """Flags of transactions without a decision."""
    return flags.join(decisions.select("transaction_id").distinct(), "transaction_id", "left_anti")


def rules_of(flags: DataFrame) -> DataFrame:
    """Per transaction: sorted distinct rules, highest score, number of rules.

    Repeated flags collapse per (transaction, rule) first, so the list built
    afterwards is as short as the number of rules.
    """
    return (
        flags.groupBy("transaction_id", "rule_name")
        .agg(F.max("risk_score").alias("risk_score"))
        .groupBy("transaction_id")
        .agg(
            F.array_join(F.sort_array(F.collect_set("rule_name")), ",").alias("rules_triggered"),
            F.max("risk_score").alias("max_risk_score"),
            F.count(F.lit(1)).alias("n_rules"),
        )
    )


def review_queue(tx: DataFrame, flags: DataFrame, decisions: DataFrame) -> DataFrame:
    """Open cases, most severe and most recent first."""
    open_cases = undecided(rules_of(flags), decisions)
    return (
        tx.join(open_cases, "transaction_id")
        .select(
            "transaction_id", "account_id", "customer_id", "ts", "amount", "transaction_type", "origin_country",
            "destination_country", "channel", "missing_customer_flag", "amount_outlier_flag", "rules_triggered",
            "max_risk_score", "n_rules",
        )
        .orderBy(F.desc("max_risk_score"), F.desc("n_rules"), F.desc("ts"), "transaction_id")
    )


def queue_size(flags: DataFrame, decisions: DataFrame) -> DataFrame:
    flagged = flags.select("transaction_id").distinct()
    return undecided(flagged, decisions).agg(F.count(F.lit(1)).alias("awaiting_review"))


def flag_evidence(tx: DataFrame, flags: DataFrame) -> DataFrame:
    """One row per flag with the transaction it belongs to."""
    return flags.join(tx, "transaction_id")


def flags_per_rule(flags: DataFrame) -> DataFrame:
    return (
        flags.groupBy("rule_name")
        .agg(F.countDistinct("transaction_id").alias("n_flagged"))
        .orderBy(F.desc("n_flagged"), "rule_name")
    )


def flag_volume(flags: DataFrame, tx: DataFrame) -> DataFrame:
    """Flagged transactions per day."""
    flagged = flags.select("transaction_id").distinct()
    return (
        tx.join(flagged, "transaction_id")
        .groupBy(F.to_date("ts").alias("day"))
        .agg(F.count(F.lit(1)).alias("flagged"))
        .orderBy("day")
    )


def decision_counts(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("decision").agg(F.count(F.lit(1)).alias("n"))


def account_history(tx: DataFrame, accounts: DataFrame, n: int = 15) -> DataFrame:
    """The ``n`` newest transactions of each selected account.

    The ranks come first: their filter is applied map-side before the shuffle,
    so a hot account ships ``n`` rows per task, and what the selection then
    joins is ``n`` rows per account.
    """
    newest = Window.partitionBy("account_id").orderBy(F.desc("ts"), F.desc("transaction_id"))
    return (
        tx.withColumn("rn", F.row_number().over(newest))
        .where(F.col("rn") <= n)
        .join(accounts.select("account_id").distinct(), "account_id", "left_semi")
        .select("account_id", "rn", "transaction_id", "ts", "amount", "transaction_type", "origin_country",
                "destination_country")
    )


def case_file(tx: DataFrame, flags: DataFrame, ids: DataFrame) -> DataFrame:
    """Selected transactions with their flags, one row per flag; unflagged ones stay with nulls."""
    wanted = ids.select("transaction_id").distinct()
    return tx.join(wanted, "transaction_id", "left_semi").join(
        flags.join(wanted, "transaction_id", "left_semi").select("transaction_id", "rule_name", "rule_detail", "risk_score"),
        "transaction_id", "left")


def orphans(child: DataFrame, parent: DataFrame, key: str = "transaction_id") -> DataFrame:
    """Child rows whose key has no parent."""
    return child.join(parent.select(key), key, "left_anti")


def check_decisions(df: DataFrame) -> DataFrame:
    """Decisions with an allowed outcome; others raise when the row is read."""
    listed = F.col("decision").isin(*OUTCOMES)
    return df.withColumn(
        "decision",
        F.when(F.coalesce(listed, F.lit(False)), F.col("decision")).otherwise(
            F.raise_error(F.concat(F.lit("unknown decision: "), F.coalesce("decision", F.lit("null"))))),
    )


def evaluate(flags: DataFrame, truth: DataFrame) -> DataFrame:
    """Precision, recall and F1 of "flagged by any rule" against the labels.

    A flagged id without label is a false positive; empty ratios are zero.
    """
    flagged = flags.groupBy("transaction_id").agg(F.lit(True).alias("_flagged"))
    labels = truth.groupBy("transaction_id").agg((F.max("is_fraud") == 1).alias("_fraud"))
    hit, bad = F.coalesce("_flagged", F.lit(False)), F.coalesce("_fraud", F.lit(False))
    counts = flagged.join(labels, "transaction_id", "full").agg(
        F.count_if(hit & bad).alias("true_positives"),
        F.count_if(hit & ~bad).alias("false_positives"),
        F.count_if(~hit & bad).alias("false_negatives"),
    )
    tp, fp, fn = (F.col(c).cast("double") for c in ("true_positives", "false_positives", "false_negatives"))
    zero = F.lit(0.0)
    precision, recall = F.coalesce(F.try_divide(tp, tp + fp), zero), F.coalesce(F.try_divide(tp, tp + fn), zero)
    return counts.withColumns({"precision": precision, "recall": recall}).withColumn(
        "f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), zero))


def screen(raw: DataFrame, truth: DataFrame, rules: dict | None = None, **clean_options) -> dict[str, DataFrame]:
    """Raw export to clean rows, report, flags and metrics.

    Clean rows and flags are written once to the shared folder because the
    rules, the queue and the metrics all read them.
    """
    clean, report = clean_transactions(raw, **clean_options)
    tx = stage_table(clean, "clean")
    flags = stage_table(run_rules(tx, **(rules or {})), "flags")
    return {"transactions": tx, "report": report, "flags": flags, "metrics": evaluate(flags, truth)}
