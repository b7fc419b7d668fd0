"""Alert queries and their idempotent sink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from finlake.operators.rules import score_transactions
from finlake.sources.sinks import ALERT_KEY

TRIGGER = "10 seconds"
# Partition of alerts whose event has no time.
NO_MONTH = "0000-00"


def _stored(df: DataFrame, path: str) -> DataFrame | None:
    """Keys of the alert table, None before its first batch; an unreadable table raises. ``df`` gives their types."""
    spark = df.sparkSession
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(place) or not any(s.isDirectory() and "=" in s.getPath().getName() for s in store.listStatus(place)):
        return None
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in df.select(*ALERT_KEY).schema]
    return spark.read.schema(", ".join([*kinds, "event_month string", "batch_id bigint"])).parquet(path)


def write_alerts(batch: DataFrame, batch_id: int, path: str) -> None:
    """Store the alerts of one micro-batch exactly once per (transaction, rule).

    A batch owns its ``batch_id`` within each event month: a replay after a failure replaces
    it. Keys stored by other batches are left out. An alert is repeated with
    its event, so only the months of the batch are looked up, however long the
    history is; alerts without event time have a month of their own.
    """
    keys = list(ALERT_KEY)
    month = F.coalesce(F.substring("timestamp", 1, 7), F.lit(NO_MONTH)) if "timestamp" in batch.columns else F.lit(NO_MONTH)
    fresh = batch.dropDuplicates(keys).withColumns({"created_at": F.current_timestamp(), "event_month": month}).drop("timestamp").persist()
    try:
        if fresh.isEmpty():
            return
        history = _stored(fresh, path)
        rows = fresh
        if history is not None:
            # No more rows than the calendar has months; the list prunes the partitions that are read.
            months = [r[0] for r in fresh.select("event_month").distinct().collect()]
            others = history.where(F.col("event_month").isin(months) & (F.col("batch_id") != batch_id)).select(*keys)
            known = others.join(fresh.select(*keys), keys, "left_semi").distinct()
            rows = fresh.join(known, keys, "left_anti")
        (
            # By size: the one month of a live batch goes to several tasks when it is large.
            rows.withColumn("batch_id", F.lit(batch_id).cast("bigint")).hint("rebalance", "event_month")
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy("event_month", "batch_id").parquet(path)
        )
    finally:
        fresh.unpersist()


def alert_query(transactions: DataFrame, path: str, checkpoint: str, once: bool = False,
                name: str = "alerts") -> StreamingQuery:
    """One query for all rules: a single read of the stream, one offset log, one alert table."""
    writer = (
        score_transactions(transactions, keep=("timestamp",)).writeStream.queryName(name)
        .outputMode("append")
        .foreachBatch(lambda df, batch_id: write_alerts(df, batch_id, path))
        .option("checkpointLocation", checkpoint)
    )
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=TRIGGER)).start()


def run_available(query: StreamingQuery, seconds: int | None = None) -> None:
    """Wait until everything available was processed, however long that takes unless ``seconds`` is given."""
    if seconds is None:
        query.awaitTermination()
    elif not query.awaitTermination(seconds):
        query.stop()
        raise TimeoutError(f"stream {query.name} did not finish in {seconds} s")


def alert_rate(alerts: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Alerts per rule and tumbling window of ``detected_at``, on a stream or a table."""
    timed = alerts.withWatermark("detected_at", late) if alerts.isStreaming else alerts
    return (
        timed.groupBy(F.window("detected_at", window), "rule_triggered")
        .agg(F.count(F.lit(1)).alias("alerts"))
        .select(F.col("window.start").alias("window_start"), "rule_triggered", "alerts")
    )


def recent_alerts(alerts: DataFrame, since: str) -> DataFrame:
    """Alerts detected at or after a time; the filter reaches the scan."""
    return alerts.where(F.col("detected_at") >= F.lit(since).cast("timestamp"))


def alert_counters(alerts: DataFrame) -> DataFrame:
    """Running number of alerts per rule (complete or update mode).

    Read the stored alerts, as a stream or table: the sink has left out what was delivered twice.
    """
    return alerts.groupBy("rule_triggered").agg(F.count(F.lit(1)).alias("alerts"))


def dedup_events(transactions: DataFrame, time: str = "event_time", delay: str = "1 hour") -> DataFrame:
    """Drop repeated transaction ids that arrive within ``delay``; state is bounded by the watermark."""
    return transactions.withWatermark(time, delay).dropDuplicatesWithinWatermark(["transaction_id"])
