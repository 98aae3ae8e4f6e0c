"""Trace events as a stream: the static redaction applied to arriving rows, and windows.

An extension of the batch trace log; redaction is stateless and the same function.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from lexspan.operators.trace import redact


def read_events(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def write_redacted(events: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Redacted rows to Parquet, each arriving file once, also across restarts."""
    return (redact(events).writeStream.format("parquet").option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start(out))


def stage_counts(events: DataFrame, time: str = "ts", late: str = "10 minutes", size: str = "5 minutes") -> DataFrame:
    """Events per window, stage and outcome; rows later than the watermark are dropped."""
    return events.withWatermark(time, late).groupBy(F.window(time, size), "stage", "outcome").agg(
        F.count(F.lit(1)).alias("events"), F.avg("duration_ms").alias("mean_duration_ms"))
