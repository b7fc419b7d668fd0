"""Table sinks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from finlake.operators.casework import check_decisions
from finlake.schemas import AML_TRANSACTIONS, DATA_QUALITY_LOG, FLAGS, GROUND_TRUTH, REVIEW_DECISIONS

# The transactional tables of one screening batch.
BATCH_TABLES: dict[str, StructType] = {
    "transactions": AML_TRANSACTIONS,
    "data_quality_log": DATA_QUALITY_LOG,
    "flags": FLAGS,
    "review_decisions": REVIEW_DECISIONS,
    "ground_truth": GROUND_TRUTH,
}
ALERT_KEY = ("transaction_id", "rule_triggered")
REQUIRED_ALERT_COLUMNS = (
    "transaction_id", "account_origin", "amount", "balance_orig_before", "balance_orig_after", "transaction_type",
    "rule_triggered", "risk_score", "alert_reason", "is_fraud", "detected_at",
)


def write_table(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Full refresh of a managed table, or of one kept under ``path``; returns the table."""
    writer = df.write.mode("overwrite").format("parquet")
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(name)
    return df.sparkSession.table(name)


def upsert(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Last write wins per key: incoming over existing, then the greatest ``order``.

    The rank filter runs map-side before the shuffle, so repeated keys do not
    travel.
    """
    both = existing.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    newest = Window.partitionBy(*keys).orderBy(F.desc("_new"), F.desc(order))
    return both.withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") == 1).drop("_rn", "_new")


def dq_log(report: DataFrame, batch_id: str) -> DataFrame:
    """Log rows of one batch; the summary is no issue."""
    return report.where(~F.col("issue_type").startswith("_summary")).select(
        F.lit(batch_id).alias("batch_id"), "issue_type", "count", "detail", F.current_timestamp().alias("logged_at"))


def append_dq_log(report: DataFrame, batch_id: str, path: str) -> None:
    """Replace the partition of the batch, so that logging it again adds nothing."""
    (
        dq_log(report, batch_id).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("batch_id").parquet(path)
    )


def refresh_flags(flags: DataFrame, path: str) -> None:
    """Flags are rewritten per run."""
    flags.withColumn("created_at", F.current_timestamp()).select(*FLAGS.names).write.mode("overwrite").parquet(path)


def record_decisions(df: DataFrame, path: str) -> None:
    """Decisions are only ever appended; an unknown outcome fails the write."""
    rows = check_decisions(df).withColumn("decided_at", F.current_timestamp())
    rows.select(*REVIEW_DECISIONS.names).write.mode("append").parquet(path)


def reset_batch(spark: SparkSession, paths: Mapping[str, str]) -> None:
    """Empty the given tables of a screening batch, keeping their schemas."""
    for name, path in paths.items():
        spark.createDataFrame([], BATCH_TABLES[name]).write.mode("overwrite").parquet(path)


def export_csv(df: DataFrame, path: str) -> None:
    """CSV with header; text is written as it is, with its white space."""
    (
        df.write.mode("overwrite").option("header", "true").option("ignoreLeadingWhiteSpace", "false")
        .option("ignoreTrailingWhiteSpace", "false").csv(path)
    )


def validate_alerts(df: DataFrame) -> DataFrame:
    """Violations of the alert table contract: (check, violations), non-zero only.

    Null, range and label checks are one aggregate; uniqueness is counted per
    key first.
    """
    checks = {f"null_{c}": F.col(c).isNull() for c in REQUIRED_ALERT_COLUMNS}
    checks["risk_score_range"] = ~F.col("risk_score").between(0, 100)
    checks["is_fraud_label"] = ~F.col("is_fraud").isin(0, 1)
    counts = df.agg(*[F.count_if(test).alias(name) for name, test in checks.items()])
    rows = F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("violations")) for n in checks])
    repeated = df.groupBy(*ALERT_KEY).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).agg(
        F.count(F.lit(1)).alias("violations")).select(F.lit("unique_transaction_rule").alias("check"), "violations")
    return counts.select(F.explode(rows).alias("r")).select("r.*").unionByName(repeated).where(F.col("violations") > 0)
