"""Hourly event counts, the same for a table and for a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def hourly(events: DataFrame, late: str | None = None) -> DataFrame:
    """hour, event_type, n and total of events (ts, event_type, value); `late` bounds a stream's state."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if late else timed
    found = timed.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return found.select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("hour"), "event_type", "n", "total")


def stream_hourly(spark: SparkSession, path: str, out: str, checkpoint: str, late: str = "2 hours") -> StreamingQuery:
    """Parquet files of events as they come, to closed hours as Parquet; what is there is worked off, then it ends."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    counts = hourly(spark.readStream.schema(schema).parquet(path), late)
    return counts.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(out)
