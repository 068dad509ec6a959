"""Structured Streaming: event-time rollups, recurrence triggers and exactly-once table sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rollup_stream(stream: DataFrame, ts: str, key: str, value: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """count, sum, min, max per key and window, closed by the watermark."""
    return (
        stream.withWatermark(ts, late).groupBy(F.window(ts, width), F.col(key))
        .agg(F.count(value).alias("count"), F.sum(value).alias("sum"), F.min(value).alias("min"), F.max(value).alias("max"))
    )


def recurs(batch: DataFrame, before: DataFrame, key: str, threshold: int) -> DataFrame:
    """Keys whose frequency passes ``threshold`` with this batch: last < threshold <= now, so each fires once."""
    new = batch.groupBy(key).agg(F.count("*").alias("more"))
    both = new.join(before.select(key, F.col("frequency").alias("last")), key, "left").select(key, F.coalesce("last", F.lit(0)).alias("last"), "more")
    return both.withColumn("now", F.col("last") + F.col("more")).where((F.col("last") < threshold) & (F.col("now") >= threshold))


def append_once(stream: DataFrame, path: str, checkpoint: str):
    """Appends each micro-batch to a folder of its own number, so a batch that runs again replaces itself."""
    return stream.writeStream.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{path}/batch={n}")).option("checkpointLocation", checkpoint)
