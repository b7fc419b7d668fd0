"""Fixed input and table schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import (
    DateType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)


def _struct(**fields) -> StructType:
    return StructType([StructField(name, kind(), True) for name, kind in fields.items()])


TRANSACTION = _struct(
    transaction_id=StringType,
    step_hour=IntegerType,
    transaction_type=StringType,
    amount=DoubleType,
    account_origin=StringType,
    balance_orig_before=DoubleType,
    balance_orig_after=DoubleType,
    account_dest=StringType,
    balance_dest_before=DoubleType,
    balance_dest_after=DoubleType,
    is_fraud=IntegerType,
    is_flagged_by_system=IntegerType,
    timestamp=StringType,
    fraud_rule_triggered=StringType,
)

PAYSIM = _struct(
    step_hour=IntegerType,
    transaction_type=StringType,
    amount=DoubleType,
    account_origin=StringType,
    balance_orig_before=DoubleType,
    balance_orig_after=DoubleType,
    account_dest=StringType,
    balance_dest_before=DoubleType,
    balance_dest_after=DoubleType,
    is_fraud=IntegerType,
    is_flagged_by_system=IntegerType,
)

ALERT_COLUMNS = (
    "transaction_id", "account_origin", "amount", "transaction_type", "rule_triggered", "risk_score",
    "alert_reason", "balance_orig_before", "balance_orig_after", "is_fraud", "detected_at",
)

RAW_AML_COLUMNS = (
    "transaction_id", "account_id", "customer_id", "timestamp", "amount", "currency",
    "transaction_type", "origin_country", "destination_country", "channel", "memo",
)
RAW_AML = _struct(**{name: StringType for name in RAW_AML_COLUMNS})

AML_TRANSACTIONS = _struct(
    transaction_id=StringType,
    account_id=StringType,
    customer_id=StringType,
    ts=TimestampType,
    amount=DoubleType,
    currency=StringType,
    transaction_type=StringType,
    origin_country=StringType,
    destination_country=StringType,
    channel=StringType,
    memo=StringType,
    missing_customer_flag=IntegerType,
    amount_outlier_flag=IntegerType,
)

DATA_QUALITY_LOG = _struct(
    batch_id=StringType, issue_type=StringType, count=LongType, detail=StringType, logged_at=TimestampType
)
FLAGS = _struct(
    transaction_id=StringType,
    rule_name=StringType,
    rule_detail=StringType,
    risk_score=IntegerType,
    created_at=TimestampType,
)
REVIEW_DECISIONS = _struct(
    transaction_id=StringType, decision=StringType, reviewer=StringType, notes=StringType, decided_at=TimestampType
)
GROUND_TRUTH = _struct(transaction_id=StringType, is_fraud=IntegerType, pattern=StringType)


def assert_schema(df: DataFrame, expected: StructType) -> DataFrame:
    """Fail before any action when a column is missing, naming it."""
    missing = [f.name for f in expected.fields if f.name not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df
