"""Mail as a stream of JSON files in a landing folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..schemas import MAIL


def messages(spark: SparkSession, landing: str, late: str = "7 days") -> DataFrame:
    """Unread messages, each uid once within the time that messages may be late."""
    rows = spark.readStream.schema(MAIL).json(landing).where("not coalesce(seen, false)")
    return rows.withWatermark("date", late).dropDuplicatesWithinWatermark(["uid"])


def start(stream: DataFrame, checkpoint: str, batch: Callable[[DataFrame, int], None], once: bool = True) -> StreamingQuery:
    """Runs batch(messages, number) on each micro-batch; the checkpoint remembers what has been read, as a mark would."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")).start()


def counts(stream: DataFrame, window: str = "1 hour") -> DataFrame:
    """Messages by window and sender, for a sink in append mode."""
    from pyspark.sql import functions as F

    return stream.groupBy(F.window("date", window), F.col("from_")).agg(F.count("*").alias("messages"))
