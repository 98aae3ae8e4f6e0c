"""What several operators of the subpackage need."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from lexspan.session import checkpoint_dir, cut_lineage

__all__ = ["cut_lineage", "shared_path", "shuffle_partitions", "table"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new place in the shared folder."""
    return os.path.join(checkpoint_dir(spark), f"{label}-{uuid.uuid4().hex}")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
