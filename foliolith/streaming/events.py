"""The event log as a stream: an addition to the batch operators, on the same schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def distinct_events(events: DataFrame, key: str = "event_id", at: str = "ts", late: str = "1 day") -> DataFrame:
    """Each event once, whatever arrives again within the watermark."""
    return events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def activity(events: DataFrame, at: str = "ts", late: str = "1 day", size: str = "1 hour") -> DataFrame:
    """Events by type and window; late ones count within the watermark."""
    e = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return e.groupBy(F.window(at, size), "event_type").agg(F.count("*").alias("n"))
