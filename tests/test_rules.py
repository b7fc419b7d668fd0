"""Boundaries of the fraud and screening rules."""

import datetime

import pytest
from pyspark.sql import functions as F

from finlake.operators import casework as C
from finlake.operators import fraud as B
from finlake.operators import rules as R
from finlake.operators import screening as S

PAY = "transaction_id string, transaction_type string, amount double, account_origin string, balance_orig_before double, balance_orig_after double, is_fraud int, is_flagged_by_system int"


@pytest.fixture(scope="module")
def pay(spark):
    return spark.createDataFrame([
        ("empty", "TRANSFER", 100.0, "C1", 100.0, 0.0, 1, 0),
        ("limit", "TRANSFER", 200000.0, "C1", 300000.0, 100000.0, 0, 0),
        ("large", "CASH_OUT", 200000.01, "C1", 300000.0, 99999.99, 1, 1),
        ("off1", "CASH_OUT", 10.0, "C1", 100.0, 91.0, 0, 0),
        ("off2", "CASH_OUT", 10.0, "C1", 100.0, 91.5, 0, 0),
        ("nulls", "TRANSFER", 10.0, "C1", None, 5.0, 0, 0),
        ("zero", "TRANSFER", 0.0, "C1", 0.0, 0.0, 0, 0),
        ("other", "PAYMENT", 900000.0, "C1", 100.0, 0.0, 1, 0),
        (None, "TRANSFER", 900000.0, "C1", 100.0, 0.0, 0, 0),
    ], PAY)


def test_fraud_rules(pay):
    hits = {(r["transaction_id"], r["rule_triggered"]) for r in R.score_transactions(R.screened(pay)).collect()}
    assert hits == {("empty", "ACCOUNT_EMPTIED"), ("large", "LARGE_AMOUNT"), ("off2", "BALANCE_MISMATCH")}


def test_single_pass_equals_three_rules(pay):
    rows = R.screened(pay)
    three = R.account_emptied(rows).unionByName(R.large_amount(rows)).unionByName(R.balance_mismatch(rows)).drop("detected_at")
    one = R.score_transactions(rows).drop("detected_at")
    assert one.exceptAll(three).count() == 0 and three.exceptAll(one).count() == 0


def test_reason_text_is_not_scientific(spark):
    df = spark.createDataFrame([("a", "TRANSFER", 12345678.9, "C", 1e9, 1e9 - 12345678.9, 0, 0)], PAY)
    assert R.large_amount(df).first()["alert_reason"] == "$12345678.90 is above the screening limit of $200,000"


def test_scorecard(pay):
    r = B.rule_scorecard(pay).first()
    assert (r["actual_fraud"], r["flagged_by_rule1"], r["flagged_by_rule2"], r["flagged_by_rule3"]) == (2, 2, 2, 2)
    assert r["our_detection_rate"] == 100.0
    assert B.rule_scorecard(pay.where("is_fraud = 0")).first()["our_detection_rate"] is None


T0 = datetime.datetime(2026, 1, 5, 0, 0, 0)
AML = "transaction_id string, account_id string, ts timestamp, amount double, transaction_type string, origin_country string, destination_country string"


def _tx(spark, rows):
    return spark.createDataFrame(
        [(i, a, T0 + datetime.timedelta(seconds=s), amt, k, "US", "CA") for i, a, s, amt, k in rows], AML)


def _ids(df):
    return sorted(r["transaction_id"] for r in df.collect())


def test_structuring(spark):
    tx = _tx(spark, [
        ("a1", "A", 10, 5000.0, "cash_deposit"), ("a2", "A", 20, 5000.0, "cash_deposit"),  # exactly the limit
        ("b1", "B", 10, 5000.0, "cash_deposit"), ("b2", "B", 20, 4999.99, "cash_deposit"),  # a cent short
        ("c1", "C", 86399, 6000.0, "cash_deposit"), ("c2", "C", 86400, 6000.0, "cash_deposit"),  # over midnight
        ("d1", "D", 10, 10000.0, "cash_deposit"),  # at the limit: not structured
        ("e1", "E", 10, 9000.0, "wire"), ("e2", "E", 10, 9000.0, "cash_deposit"),
    ])
    assert _ids(S.rule_structuring(tx)) == ["a1", "a2"]
    detail = S.rule_structuring(tx).first()["rule_detail"]
    assert "2 cash deposits on 2026-01-05 for account A totalling $10,000.00" in detail


def test_velocity_window_is_closed(spark):
    rows = [(f"a{i}", "A", i * 720, 1.0, "card") for i in range(6)]  # 6 in exactly 3600 s
    rows += [(f"b{i}", "B", i * 721, 1.0, "card") for i in range(6)]  # one second too slow
    rows += [(f"c{i}", "C", 50, 1.0, "card") for i in range(6)]  # peers of one second
    rows += [(f"d{i}", "D", 86400 - 100 + i * 40, 1.0, "card") for i in range(6)]  # over a block border
    assert _ids(S.rule_velocity(_tx(spark, rows))) == ["a5"] + [f"c{i}" for i in range(6)] + ["d5"]


def test_velocity_brute_force(spark):
    rows = [(f"t{i}", f"A{i % 3 if i % 2 else 0}", (i * 7919) % 300000, 1.0, "card") for i in range(800)]
    want = []
    for i, a, s, _, _ in rows:
        if sum(1 for _, b, t, _, _ in rows if b == a and s - 3600 <= t <= s) >= 6:
            want.append(i)
    assert _ids(S.rule_velocity(_tx(spark, rows))) == sorted(want) and want


def test_round_dollar(spark):
    tx = _tx(spark, [("a", "A", 1, 5000.0, "wire"), ("b", "A", 1, 5000.5, "wire"), ("c", "A", 1, 4000.0, "transfer"),
                     ("d", "A", 1, 7000.0, "card"), ("e", "A", 1, 3e12, "transfer"), ("f", "A", 1, 5500.0, "wire")])
    assert _ids(S.rule_round_dollar(tx)) == ["a", "e"]


def test_layering(spark):
    tx = _tx(spark, [
        ("a1", "A", 0, 5000.0, "wire"), ("a2", "A", 10800, 4601.0, "transfer"),  # 3 h, 7.98 %
        ("b1", "B", 0, 5000.0, "wire"), ("b2", "B", 10801, 5000.0, "transfer"),  # a second late
        ("c1", "C", 0, 5000.0, "wire"), ("c2", "C", 60, 4600.0, "transfer"),  # exactly 8 %
        ("d1", "D", 0, 5000.0, "wire"), ("dx", "D", 30, 5000.0, "card"), ("d2", "D", 60, 5000.0, "transfer"),  # card ignored
        ("e1", "E", 0, 5000.0, "wire"), ("ex", "E", 30, 1.0, "ach"), ("e2", "E", 60, 5000.0, "transfer"),  # ach between
        ("f1", "F", 0, 5000.0, "wire"), ("f2", "F", 60, 5000.0, "wire"), ("f3", "F", 90, 5000.0, "transfer"),  # chain
        ("g1", "G", 86390, 5000.0, "wire"), ("g2", "G", 86410, 5000.0, "transfer"),  # over midnight
    ])
    want = ["a1", "a2", "d1", "d2", "f1", "f2", "f2", "f3", "g1", "g2"]
    assert _ids(S.rule_layering(tx)) == want
    assert _ids(S.rule_layering(tx)) == want
    detail = S.rule_layering(tx).where("transaction_id = 'a1'").first()["rule_detail"]
    assert detail == "$5,000.00 in, $4,601.00 out after 3.0h (account A)"


FLAG = "transaction_id string, rule_name string, rule_detail string, risk_score int"


def test_evaluate(spark):
    flags = spark.createDataFrame([("a", "r", "", 1), ("a", "q", "", 3), ("b", "r", "", 1), ("ghost", "r", "", 1)], FLAG)
    truth = spark.createDataFrame([("a", 1), ("b", 0), ("c", 1), ("d", 0)], "transaction_id string, is_fraud int")
    r = C.evaluate(flags, truth).first()
    assert (r["true_positives"], r["false_positives"], r["false_negatives"]) == (1, 2, 1)
    assert (r["precision"], r["recall"]) == (pytest.approx(1 / 3), 0.5)
    none = C.evaluate(flags.where("false"), truth.where("false")).first()
    assert (none["precision"], none["recall"], none["f1"]) == (0.0, 0.0, 0.0)


def test_queue_order_and_lists(spark):
    tx = _tx(spark, [("a", "A", 1, 1.0, "wire"), ("b", "A", 2, 1.0, "wire"), ("c", "A", 3, 1.0, "wire"), ("d", "A", 4, 1.0, "wire")])
    tx = tx.withColumns({"customer_id": F.lit("c"), "channel": F.lit("x"), "missing_customer_flag": F.lit(0), "amount_outlier_flag": F.lit(0)})
    flags = spark.createDataFrame([
        ("a", "velocity", "", 2), ("b", "structuring", "", 3), ("c", "structuring", "", 3), ("c", "geo", "", 3), ("c", "geo", "", 3),
        ("d", "structuring", "", 3)], FLAG)
    decisions = spark.createDataFrame([("d", "cleared"), ("d", "escalated")], "transaction_id string, decision string")
    rows = C.review_queue(tx, flags, decisions).collect()
    assert [(r["transaction_id"], r["rules_triggered"], r["n_rules"]) for r in rows] == [
        ("c", "geo,structuring", 2), ("b", "structuring", 1), ("a", "velocity", 1)]
    assert C.queue_size(flags, decisions).first()[0] == 3


def test_unknown_decision_fails(spark):
    bad = spark.createDataFrame([("a", "maybe")], "transaction_id string, decision string")
    with pytest.raises(Exception, match="unknown decision: maybe"):
        C.check_decisions(bad).collect()


def test_screen_end_to_end(spark):
    schema = "transaction_id string, account_id string, customer_id string, `timestamp` string, amount string, currency string, transaction_type string, origin_country string, destination_country string, channel string, memo string, ingest_no long"
    raw = spark.createDataFrame([
        ("a", "A", "C", "2026-01-05 10:00:00", "6,000", "usd", "cash_deposit", "US", "CA", "w", "m", 1),
        ("b", "A", "C", "2026-01-05T11:00:00", "$6000.00", "USD", "cash_deposit", "US", "CA", "w", "m", 2),
        ("b", "A", "C", "2026-01-05T11:00:00", "$6000.00", "USD", "cash_deposit", "US", "CA", "w", "m", 3),
        ("c", "B", "C", "2026-01-05T11:00:00", "x", "USD", "wire", "XA", "CA", "w", "m", 4),
        ("d", "B", "C", "2026-01-05T11:00:00", "50", "USD", "wire", "XA", "CA", "w", "m", 5),
    ], schema)
    truth = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1), ("d", 0)], "transaction_id string, is_fraud int")
    out = C.screen(raw, truth)
    assert sorted((r["transaction_id"], r["rule_name"]) for r in out["flags"].collect()) == [
        ("a", "structuring"), ("b", "structuring"), ("d", "high_risk_geo")]
    m = out["metrics"].first()
    assert (m["true_positives"], m["false_positives"], m["false_negatives"]) == (2, 1, 1)
