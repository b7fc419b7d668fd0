"""Readers, sinks and profiles."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from finlake import schemas
from finlake.session import drop_staged, stage_table
from finlake.sources import profile, readers, sinks


def test_csv_strings_missing_tokens(spark, tmp_path):
    path = tmp_path / "raw.csv"
    path.write_text('a,b\nn/a,  n/a  \nNULL,x\n,"q,""z"\nNaN, NA\n')
    rows = [tuple(r) for r in readers.read_csv_strings(spark, str(path), ["a", "b"]).collect()]
    assert rows[0] == (None, "  n/a  ") and rows[1] == (None, "x") and rows[2][0] is None and rows[3][0] is None


def test_upload_and_router(spark, tmp_path):
    path = tmp_path / "Up.CSV"
    path.write_bytes("Total Price,Café\n1,é\n2,b\n".encode("latin-1"))
    assert readers.load_upload(spark, str(path)) == (["total_price", "café"], 2)
    kind, df = readers.route_source(spark, str(path))
    assert kind == "sql" and df.first()[1] == "é"
    other = tmp_path / "x.csv"
    other.write_text("k\n5\n")
    readers.load_upload(spark, str(other))
    assert spark.table("uploaded_data").columns == ["k"]
    note = tmp_path / "n.txt"
    note.write_text("one\ntwo\n")
    kind, docs = readers.route_source(spark, str(note))
    assert kind == "rag" and docs.first()["text"] == "one\ntwo\n"
    with pytest.raises(ValueError, match="Unsupported file type"):
        readers.route_source(spark, str(tmp_path / "x.exe"))


def test_staged_csv(spark, tmp_path):
    path = tmp_path / "p.csv"
    path.write_text("step_hour,transaction_type,amount\n1,\"TRANS,FER\",2.5\n")
    df = readers.read_staged_csv(spark, str(path), StructType(schemas.PAYSIM.fields[:3]))
    assert tuple(df.first()) == (1, "TRANS,FER", 2.5)


def test_upsert_last_write_wins(spark):
    old = spark.createDataFrame([("a", 1, 10), ("b", 2, 99)], "k string, v int, o int")
    new = spark.createDataFrame([("a", 3, 1), ("a", 4, 2), ("c", 5, 1)], "k string, v int, o int")
    assert {r["k"]: r["v"] for r in sinks.upsert(old, new, ["k"], "o").collect()} == {"a": 4, "b": 2, "c": 5}


def test_write_table_replaces(spark, tmp_path):
    path = str(tmp_path / "t")
    assert sinks.write_table(spark.range(5), "finlake_t", path).count() == 5
    assert sinks.write_table(spark.range(2), "finlake_t", path).count() == 2


def test_decisions_append_flags_refresh_reset(spark, tmp_path):
    d = spark.createDataFrame([("a", "cleared", "me", "")], "transaction_id string, decision string, reviewer string, notes string")
    path, fpath = str(tmp_path / "d"), str(tmp_path / "f")
    sinks.record_decisions(d, path)
    sinks.record_decisions(d.withColumn("decision", F.lit("escalated")), path)
    assert spark.read.parquet(path).count() == 2
    with pytest.raises(Exception, match="unknown decision"):
        sinks.record_decisions(d.withColumn("decision", F.lit("nope")), path)
    flags = spark.createDataFrame([("a", "r", "x", 1)], "transaction_id string, rule_name string, rule_detail string, risk_score int")
    for _ in range(2):
        sinks.refresh_flags(flags, fpath)
    assert spark.read.parquet(fpath).count() == 1
    sinks.reset_batch(spark, {"review_decisions": path, "flags": fpath})
    assert spark.read.parquet(path).count() == 0 and spark.read.parquet(path).schema.names == schemas.REVIEW_DECISIONS.names


def test_validate_alerts_clean(spark):
    good = spark.createDataFrame(
        [("a", "C", 1.0, "TRANSFER", "R", 85, "x", 1.0, 0.0, 1, "2026-01-01")],
        "transaction_id string, account_origin string, amount double, transaction_type string, rule_triggered string, risk_score int, alert_reason string, balance_orig_before double, balance_orig_after double, is_fraud int, detected_at string")
    assert sinks.validate_alerts(good).count() == 0
    bad = good.unionByName(good).withColumn("is_fraud", F.lit(2))
    assert {r["check"]: r["violations"] for r in sinks.validate_alerts(bad).collect()} == {"is_fraud_label": 2, "unique_transaction_rule": 1}


def test_profile(spark):
    df = spark.createDataFrame([(1, "x"), (2, "x"), (None, None)], "n int, s string")
    p = profile.profile(df)
    assert (p["rows"], p["columns"]) == (3, 2)
    rows = {r["column"]: r for r in profile.describe_all(df).collect()}
    assert (rows["n"]["count"], rows["n"]["mean"], rows["n"]["p50"]) == (2, 1.5, 1.5)
    assert (rows["s"]["unique"], rows["s"]["top"], rows["s"]["freq"]) == (1, "x", 2)


def test_staged_tables_can_be_dropped(spark):
    assert stage_table(spark.range(3), "probe").count() == 3
    assert drop_staged(spark)
