"""Sinks: CSV ledgers, JSON lines, vector shards. Spark's committer makes them atomic."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def write_ledger(df: DataFrame, path: str) -> None:
    """CSV with header and byte order mark in every part file."""
    names = [("\ufeff" if i == 0 else "") + name for i, name in enumerate(df.columns)]
    df.toDF(*names).write.csv(path, header=True, quote='"', escape='"', encoding="UTF-8")


def write_json_lines(df: DataFrame, path: str, ascii_only: bool = True) -> None:
    """One record per line; ``ascii_only`` escapes every other character, so readers that
    split on Unicode line separators keep records whole."""
    df.write.option("writeNonAsciiCharacterAsCodePoint", str(ascii_only).lower()).option("ignoreNullFields", "false").json(path)


def write_shards(df: DataFrame, path: str, order: Sequence[str], shard_rows: int = 256) -> None:
    """JSON shards of at most ``shard_rows`` rows in the given order."""
    (df.repartitionByRange(*order).sortWithinPartitions(*order).write
     .option("maxRecordsPerFile", shard_rows).option("ignoreNullFields", "false").json(path))
