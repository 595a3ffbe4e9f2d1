"""Incremental maps with Structured Streaming: sums by pixel are additive, so update mode reproduces the batch map."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def pixel_stream(spark: SparkSession, schema: T.StructType, path: str, npix: int = 48) -> DataFrame:
    """Running (pix, hits, total) of the event files that land in a folder."""
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    pix = (F.col("event_id") * 31 + F.col("user_id") * 17) % npix
    return events.groupBy(pix.alias("pix")).agg(F.count("*").alias("hits"), F.sum("value").alias("total"))


def windowed_counts(spark: SparkSession, schema: T.StructType, path: str, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Event-time windows with a watermark: an addition of this library, not part of map making."""
    events = spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))


def run_to_end(frame: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Drive a stream over what is there, into a table in memory (for tests and small results)."""
    stream = frame.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    stream.awaitTermination()
    return frame.sparkSession.table(name)
