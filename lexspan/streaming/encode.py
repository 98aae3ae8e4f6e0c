"""Resumable encoding: record files as a stream, the checkpoint as the progress file."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, types as T


def encode_available(spark: SparkSession, records: str, schema: T.StructType, encode: Callable[[DataFrame], DataFrame],
                     out: str, checkpoint: str, files_per_batch: int = 100) -> None:
    """Encode every record file not encoded yet and stop. A run that is cut off goes on
    with the files whose batch was not committed; committed vectors are not made again."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(records)
    (encode(stream).writeStream.format("parquet").option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start(out).awaitTermination())
