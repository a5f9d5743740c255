"""The collection monitor as a stream: windowed counts with late data, latest events, alerts.

Run with ``trigger(availableNow=True)`` under any scheduler, or continuously.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read(spark: SparkSession, path: str, schema, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed(events: DataFrame, size: str = "24 hours", slide: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Successes, failures and products by lender in sliding windows."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", size, slide), "lender")
    return w.agg(F.count_if("success").alias("successful"), F.count_if(~F.col("success")).alias("failed"), F.coalesce(F.sum("products"), F.lit(0)).cast("long").alias("products")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "lender", "successful", "failed", "products")


def latest(events: DataFrame) -> DataFrame:
    """The latest event per lender and type (update or complete mode)."""
    return events.groupBy("lender", "collection_type").agg(F.max(F.struct("ts", "event_id", "success", "products")).alias("e")).select("lender", "collection_type", "e.*")


def alerts(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """One alert per failed event, however often it is delivered within the watermark."""
    return events.where(~F.col("success")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def write(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    return df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(path)
