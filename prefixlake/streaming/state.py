"""Streams of samples and writes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def interval_counts(samples: DataFrame, seconds: int = 30, late: str = "10 seconds") -> DataFrame:
    """Counts for each tumbling event-time interval of a stream (ts, op), final once the watermark has passed."""
    x = samples.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return x.groupBy(F.window("ts", f"{seconds} seconds").alias("w")).agg(
        F.count("*").alias("operations"), F.count_if(F.col("op") == "read").alias("verified"), F.count_if(F.col("op") == "error").alias("errors")
    ).select(F.col("w.start").alias("start"), "operations", "verified", "errors")


def without_retries(writes: DataFrame, key: list[str], late: str = "10 minutes") -> DataFrame:
    """A stream of writes (ts, ...) with repeats of a key dropped while it is remembered."""
    return writes.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(key)

