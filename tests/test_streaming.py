"""Alert stream: batch equality, restart, replay, repeated events."""

import json

import pytest
from pyspark.sql import functions as F

from finlake.operators import rules as R
from finlake.schemas import TRANSACTION
from finlake.streaming import alerts as A
from finlake.streaming.events import message_source, read_events

BASE = dict(step_hour=1, account_origin="C1", balance_orig_before=500000.0, balance_orig_after=0.0, account_dest="M1",
            balance_dest_before=0.0, balance_dest_after=0.0, is_fraud=1, is_flagged_by_system=0, timestamp="2026-01-05T10:00:00",
            fraud_rule_triggered=None)


def _message(i, kind="TRANSFER", amount=500000.0):
    return json.dumps({**BASE, "transaction_id": i, "transaction_type": kind, "amount": amount})


def _feed(folder, name, lines):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(lines) + "\n")


def _run(spark, folder, out, checkpoint):
    stream = read_events(spark.readStream.text(str(folder)))
    A.run_available(A.alert_query(stream, str(out), str(checkpoint), once=True))


def test_broken_messages_and_types_are_dropped(spark):
    lines = [_message("t1"), _message("t2", "PAYMENT"), "{broken", _message(None), "", _message("t3", "CASH_OUT")]
    df = spark.createDataFrame([(m,) for m in lines], "value string")
    out = read_events(df)
    assert out.schema.names == TRANSACTION.names
    assert sorted(r["transaction_id"] for r in out.collect()) == ["t1", "t3"]


def test_stream_restart_and_repeats(spark, tmp_path):
    src, out, ckpt = tmp_path / "in", tmp_path / "out", tmp_path / "ckpt"
    _feed(src, "1.txt", [_message("t1"), _message("t1"), _message("t2", amount=10.0)])
    _run(spark, src, out, ckpt)
    first = spark.read.parquet(str(out)).count()
    # t1: emptied and large; t2: emptied and mismatched.
    assert first == 4
    _run(spark, src, out, ckpt)
    assert spark.read.parquet(str(out)).count() == first
    # A repeated event in a later batch adds nothing, a new one does.
    _feed(src, "2.txt", [_message("t1"), _message("t9")])
    _run(spark, src, out, ckpt)
    rows = spark.read.parquet(str(out))
    assert rows.count() == first + 2
    assert rows.groupBy("transaction_id", "rule_triggered").count().where("count > 1").isEmpty()
    batch = R.score_transactions(read_events(spark.read.text(str(src)))).select("transaction_id", "rule_triggered").distinct()
    assert batch.exceptAll(rows.select("transaction_id", "rule_triggered")).isEmpty()


def test_replayed_batch_replaces_itself(spark, tmp_path):
    alerts = R.score_transactions(read_events(spark.createDataFrame([(_message("t1"),), (_message("t2"),)], "value string")))
    path = str(tmp_path / "alerts")
    A.write_alerts(alerts, 7, path)
    A.write_alerts(alerts, 7, path)
    A.write_alerts(alerts, 8, path)
    A.write_alerts(alerts.where("false"), 9, path)
    rows = spark.read.parquet(path)
    assert rows.count() == 4 and [r[0] for r in rows.select("batch_id").distinct().collect()] == [7]


def test_sink_looks_only_at_the_months_of_a_batch(spark, tmp_path):
    path = str(tmp_path / "alerts")

    def batch(i, day):
        message = json.dumps({**json.loads(_message(i)), "timestamp": f"{day}T10:00:00"})
        return R.score_transactions(read_events(spark.createDataFrame([(message,)], "value string")), keep=("timestamp",))

    A.write_alerts(batch("t1", "2026-01-05"), 1, path)
    A.write_alerts(batch("t1", "2026-01-05"), 2, path)
    stored = spark.read.parquet(path)
    assert stored.count() == 2 and [r[0] for r in stored.select("event_month").distinct().collect()] == ["2026-01"]
    for file in (tmp_path / "alerts" / "event_month=2026-01" / "batch_id=1").glob("*.parquet"):
        file.with_name("." + file.name + ".crc").unlink(missing_ok=True)
        file.write_bytes(b"broken")
    A.write_alerts(batch("t2", "2026-02-01"), 3, path)
    with pytest.raises(Exception, match="(?i)parquet|read"):
        A.write_alerts(batch("t3", "2026-01-06"), 4, path)


def test_alert_rate_on_a_stream(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    _feed(src, "1.txt", [_message("t1"), _message("t2"), _message("t3", amount=10.0)])
    alerts = R.score_transactions(read_events(spark.readStream.text(str(src)))).withColumn(
        "detected_at", F.lit("2026-01-05 10:20:00").cast("timestamp"))
    query = (A.alert_rate(alerts, "1 hour").writeStream.outputMode("complete").format("memory").queryName("rates")
             .option("checkpointLocation", str(out)).trigger(availableNow=True).start())
    A.run_available(query)
    got = {r["rule_triggered"]: (str(r["window_start"]), r["alerts"]) for r in spark.table("rates").collect()}
    assert got == {"ACCOUNT_EMPTIED": ("2026-01-05 10:00:00", 3), "LARGE_AMOUNT": ("2026-01-05 10:00:00", 2),
                   "BALANCE_MISMATCH": ("2026-01-05 10:00:00", 1)}


def test_dedup_within_watermark(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    _feed(src, "1.txt", [_message("t1"), _message("t1"), _message("t2")])
    stream = read_events(spark.readStream.text(str(src))).withColumn("event_time", F.to_timestamp("timestamp"))
    query = (A.dedup_events(stream).writeStream.format("memory").queryName("unique_events")
             .option("checkpointLocation", str(out)).trigger(availableNow=True).start())
    A.run_available(query)
    assert spark.table("unique_events").count() == 2


def test_source_options():
    options = message_source("host:9092", "tx", per_trigger=1000)
    assert options["startingOffsets"] == "latest" and options["failOnDataLoss"] == "false"
    assert options["maxOffsetsPerTrigger"] == "1000"


def test_counters_and_recent(spark):
    alerts = spark.createDataFrame([("a", "R1", "2026-01-05 10:00:00"), ("b", "R1", "2026-01-05 11:00:00"), ("c", "R2", "2026-01-05 12:00:00")],
                                   "transaction_id string, rule_triggered string, at string").withColumn("detected_at", F.to_timestamp("at"))
    assert {r["rule_triggered"]: r["alerts"] for r in A.alert_counters(alerts).collect()} == {"R1": 2, "R2": 1}
    assert A.recent_alerts(alerts, "2026-01-05 11:00:00").count() == 2


@pytest.mark.parametrize("once", [True])
def test_live_trigger_is_configurable(spark, tmp_path, once):
    src = tmp_path / "in"
    _feed(src, "1.txt", [_message("t1")])
    query = A.alert_query(read_events(spark.readStream.text(str(src))), str(tmp_path / "o"), str(tmp_path / "c"), once=once, name="once")
    A.run_available(query, 120)
    assert query.exception() is None


def test_sink_skips_the_months_between(spark, tmp_path):
    path = str(tmp_path / "alerts")
    schema = "transaction_id string, rule_triggered string, timestamp string"

    def batch(*rows):
        return spark.createDataFrame([(i, "r", t) for i, t in rows], schema)

    A.write_alerts(batch(("old", "2024-03-01T00:00:00"), ("new", "2026-01-01T00:00:00"), ("none", None)), 1, path)
    # Without a time and of 2026: what lies between them is neither read nor changed.
    A.write_alerts(batch(("old", "2026-01-02T00:00:00"), ("new", "2026-01-03T00:00:00"), ("none", None), ("more", None)), 2, path)
    rows = sorted((r["transaction_id"], r["event_month"], r["batch_id"]) for r in spark.read.parquet(path).collect())
    assert rows == [("more", "0000-00", 2), ("new", "2026-01", 1), ("none", "0000-00", 1), ("old", "2024-03", 1), ("old", "2026-01", 2)]
