"""Streaming form of the time-bucket query: tumbling windows with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streaming_activity(observations: DataFrame, bucket: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Observations in each window of ``bucket``; a window is final once the watermark passes it.

    Works on batch and streaming frames alike.  Distinct counts are
    approximate here, since an exact one would keep all values as state.
    """
    rows = observations.withColumn("observed_at", F.col("observed_at").cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark("observed_at", late)
    grouped = rows.groupBy(F.window("observed_at", bucket).alias("w")).agg(F.count("*").alias("observation_count"), F.approx_count_distinct("txid").alias("transaction_count"))
    return grouped.select(F.col("w.start").alias("bucket_start"), "observation_count", "transaction_count")
