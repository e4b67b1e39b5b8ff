"""Where notifications go: a channel takes a batch once, however often the batch runs."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.keyed import KeyedTable

NOTIFICATION = "notification_id string, user_id string, title string, created_at timestamp, is_read boolean"


class Channel(Protocol):
    def send(self, batch: DataFrame, number: int) -> None: ...


class InApp:
    """Notifications in a keyed table. The commit that a batch makes is the version after its number, so a batch that runs again
    after its commit does nothing, and one that was killed before it leaves files that no commit names."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.table = KeyedTable(spark, path, NOTIFICATION, ["notification_id"])

    def send(self, batch: DataFrame, number: int) -> None:
        if self.table.manifest()["version"] <= number:
            self.table.upsert(batch.dropDuplicates(["notification_id"]).withColumn("is_read", F.lit(False)))

    def sent(self) -> DataFrame:
        return self.table.read()


def deliver(notifications: DataFrame, channel: Channel, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Send a stream of notifications (notification_id, user_id, title, created_at) batch by batch."""
    writer = notifications.writeStream.foreachBatch(lambda batch, number: channel.send(batch, number)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
