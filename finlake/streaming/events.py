"""Transaction event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finlake.operators.rules import screened
from finlake.schemas import TRANSACTION


def read_events(stream: DataFrame) -> DataFrame:
    """Parse the JSON in ``value``; broken messages and other types are dropped.

    Works on any source with a text or binary ``value``, stream or batch. The
    parsed struct passes through ``inline``: filters on its fields stay above
    that step, where otherwise each of them would parse the message again.
    """
    tx = F.from_json(F.col("value").cast("string"), TRANSACTION)
    return screened(stream.select(F.inline(F.array(tx))))


def message_source(servers: str, topic: str, starting: str = "latest", per_trigger: int | None = None,
                   fail_on_data_loss: bool = False) -> dict[str, str]:
    """Reader options of a message-queue topic: start position and data-loss tolerance."""
    options = {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        "startingOffsets": starting,
        "failOnDataLoss": str(fail_on_data_loss).lower(),
    }
    if per_trigger:
        options["maxOffsetsPerTrigger"] = str(per_trigger)
    return options


def read_topic(spark: SparkSession, options: dict[str, str]) -> DataFrame:
    """Event stream of a topic; needs the Kafka connector on the class path."""
    return read_events(spark.readStream.format("kafka").options(**options).load())
