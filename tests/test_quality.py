"""Edge cases of cleaning."""

import datetime

import pytest
from pyspark.sql import functions as F

from finlake.functions.parsing import parse_amount, parse_date, parse_ts
from finlake.operators import quality as Q
from finlake.schemas import RAW_AML, RAW_AML_COLUMNS, assert_schema


def _one(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r["o"] for r in df.select("i", fn("s").alias("o")).orderBy("i").collect()]


def test_parse_amount(spark):
    values = ["$1,234.00", "(100)", "1e5", "1-2", "-", ".", "", "abc", None, "-5", "5.", ".5", "1.2.3"]
    assert _one(spark, values, parse_amount) == [
        1234.0, 100.0, 15.0, None, None, None, None, None, None, -5.0, 5.0, 0.5, None]


def test_parse_ts_month_first_and_day_first(spark):
    t = datetime.datetime
    values = ["05-01-2026 10:00:00", "13-01-2026 10:00:00", "2026-01-05T10:00:00", "01/05/2026 10:00", " 2026-01-05 10:00:00 ", "nope", "", None]
    assert _one(spark, values, parse_ts) == [
        t(2026, 5, 1, 10), t(2026, 1, 13, 10), t(2026, 1, 5, 10), t(2026, 1, 5, 10), t(2026, 1, 5, 10), None, None, None]
    assert _one(spark, values, lambda c: parse_ts(c, day_first=True))[0] == t(2026, 1, 5, 10)


def test_parse_ts_lenient_layouts(spark):
    t = datetime.datetime
    values = ["1/5/2026 09:00", "2026/01/05 10:00", "Jan 5 2026 10:00", "01/05/2026 9:00 PM", "January 5, 2026 12:30 am", "5 Jan 2026",
              "1-5-2026 7:08:09", "12/31/2026 12:00 p.m.", "13/13/2026 10:00", "Janet 5", "2026/1/5", "01/05/2026 13:00 PM"]
    assert _one(spark, values, parse_ts) == [
        t(2026, 1, 5, 9), t(2026, 1, 5, 10), t(2026, 1, 5, 10), t(2026, 1, 5, 21), t(2026, 1, 5, 0, 30), t(2026, 1, 5),
        t(2026, 1, 5, 7, 8, 9), t(2026, 12, 31, 12), None, None, t(2026, 1, 5), None]


def test_parse_date(spark):
    d = datetime.date
    assert _one(spark, ["05/01/2026", "31/02/2000", "2026-01-05", "12/25/2020", "x"], parse_date) == [
        d(2026, 1, 5), None, d(2026, 1, 5), d(2020, 12, 25), None]


RAW = [
    # id, account, customer, timestamp, amount, currency, type, origin, destination, channel, memo, ordinal
    ("T1", "A", "C1", "2026-01-05 10:00:00", "100", "USD", "wire", " US", "CA", "web", " hi ", 1),
    ("T1", "A", "C1", "2026-01-05 10:00:00", "999", "USD", "wire", "US", "CA", "web", "hi", 0),
    ("T2", "A", "", "05-01-2026 10:00:00", "$120.00", "usd", "wire", "US", "CA", "web", "m", 2),
    ("T3", "A", None, "bad", "110", "USD", "wire", "US", "CA", "web", "m", 3),
    ("T4", "A", "C1", "2026-01-05 11:00:00", "n", "USD", "wire", "US", "CA", "web", "m", 4),
    ("T5", "A", "C1", "2026-01-05 12:00:00", "90000", None, "wire", "US", "CA", "web", None, 5),
    (None, "A", "C1", "2026-01-05 12:00:00", "105", "USD", "wire", "US", "CA", "web", "m", 6),
    (None, "A", "C1", "2026-01-05 12:00:00", "105", "USD", "wire", "US", "CA", "web", "m", 7),
]


@pytest.fixture(scope="module")
def raw(spark):
    schema = ", ".join(f"`{c}` string" for c in RAW_AML_COLUMNS) + ", ingest_no long"
    return spark.createDataFrame(RAW, schema)


@pytest.mark.parametrize("stage", [True, False])
def test_clean_and_report(raw, stage):
    clean, report = Q.clean_transactions(raw, stage=stage)
    rows = {r["transaction_id"]: r for r in clean.collect()}
    assert set(rows) == {"T1", "T2", "T5", None}
    assert rows["T1"]["amount"] == 999.0 and rows["T1"]["memo"] == "hi"
    assert rows["T2"]["currency"] == "USD" and rows["T2"]["customer_id"] is None and rows["T2"]["missing_customer_flag"]
    assert rows["T5"]["currency"] is None and rows["T5"]["memo"] is None
    # Amounts of A: 999, 120, 110, 90000, 105 -> median 120, so 8 x 120 and 5,000 are exceeded once.
    assert [r["transaction_id"] for r in rows.values() if r["amount_outlier_flag"]] == ["T5"]
    counts = {r["issue_type"]: r["count"] for r in report.collect()}
    assert counts == {
        "duplicate_transaction_id": 2, "amount_unparseable": 1, "amount_outlier_flagged": 1, "timestamp_unparseable": 1,
        "currency_normalized": 1, "missing_customer_id": 1,
        "_summary.rows_in": 8, "_summary.rows_out": 4, "_summary.rows_dropped": 4,
    }
    assert counts["_summary.rows_in"] == counts["_summary.rows_out"] + counts["_summary.rows_dropped"]


def test_empty_input(spark, raw):
    clean, report = Q.clean_transactions(raw.where("false"))
    assert clean.count() == 0
    assert {r["issue_type"]: r["count"] for r in report.collect()} == {
        "_summary.rows_in": 0, "_summary.rows_out": 0, "_summary.rows_dropped": 0}


def test_schema_check_names_the_column(raw):
    with pytest.raises(ValueError, match="memo"):
        assert_schema(raw.drop("memo"), RAW_AML)


def test_outlier_boundary(spark):
    rows = [(str(i), "A", 1000.0) for i in range(5)] + [("x", "A", 8000.0), ("y", "A", 8000.01), (
        "z", None, 99999.0)]
    df = spark.createDataFrame(rows, "transaction_id string, account_id string, amount double")
    hit = Q.flag_outliers(df).where(F.col("amount_outlier_flag")).collect()
    assert [r["transaction_id"] for r in hit] == ["y"]
