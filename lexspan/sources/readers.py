"""Scans: Parquet by ids, CSV ledgers, JSON lines, JSON documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from lexspan.session import cut_lineage


def require_unique(df: DataFrame, keys: Sequence[str], what: str = "rows") -> DataFrame:
    """The rows, after a check that stops at the first repeated key."""
    repeated = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).collect()
    if repeated:
        raise ValueError(f"duplicate {what}: {repeated[0].asDict()}")
    return df


def starts(counts: DataFrame, keys: Sequence[str], count: str = "n") -> DataFrame:
    """Adds ``start``: the sum of the counts of all smaller keys. Keys are dealt out in ranges;
    only the ranges' sums are added up in one place."""
    # Written, so that every later read sees the same ranges.
    placed = cut_lineage(counts.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("place", F.monotonically_increasing_id()).withColumn(
        "range", F.shiftright("place", 33)))
    before = F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    bases = placed.groupBy("range").agg(F.sum(count).alias("n")).select("range", F.coalesce(before, F.lit(0)).alias("base"))
    within = F.sum(count).over(Window.partitionBy("range").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    return placed.withColumn("within", F.coalesce(within, F.lit(0))).join(bases, "range").select(
        *keys, (F.col("base") + F.col("within")).alias("start"))


def read_with_place(spark: SparkSession, *paths: str) -> list[DataFrame]:
    """Each path's Parquet rows with ``row_index`` as a struct that orders them as
    ``read_in_order`` does: enough to tell the last row of an id, without a count or a join."""
    return [spark.read.parquet(path).select("*", F.struct(F.lit(number).alias("input"), F.col("_metadata.file_path").alias("file"),
                                                          F.col("_metadata.row_index").alias("row")).alias("row_index")) for number, path in enumerate(paths)]


def read_in_order(spark: SparkSession, *paths: str) -> list[DataFrame]:
    """Each path's Parquet rows with ``row_index``, their place in the order of the input:
    paths as given, files by name, rows as they are stored.

    Two passes: the first counts rows per file (footers are enough), the second adds a
    file's start to the position that the scan gives each row.
    """
    place = ["__input", "__file"]
    parts = [spark.read.parquet(path).select("*", F.lit(number).alias("__input"), F.col("_metadata.file_path").alias("__file"),
                                             F.col("_metadata.row_index").alias("__row")) for number, path in enumerate(paths)]
    counts = None
    for part in parts:
        own = part.groupBy(*place).agg(F.count(F.lit(1)).alias("n"))
        counts = own if counts is None else counts.unionAll(own)
    offsets = cut_lineage(starts(counts, place))
    return [part.join(offsets, place).withColumn("row_index", F.col("start") + F.col("__row")).drop(*place, "__row", "start") for part in parts]


def read_by_ids(spark: SparkSession, path: str, ids: Sequence[str], key: str = "id") -> DataFrame:
    """Parquet rows of the given ids; the IN filter reaches the scan, ids must be unique."""
    return require_unique(spark.read.parquet(path).where(F.col(key).isin(*ids)), [key], f"{key}s in {path}")


def read_edges_touching(spark: SparkSession, path: str, ids: Sequence[str]) -> DataFrame:
    return spark.read.parquet(path).where(F.col("doc_id").isin(*ids) | F.col("other_doc_id").isin(*ids))


def read_ledger(spark: SparkSession, path: str, ids: Sequence[str] | None = None, key: str = "id") -> DataFrame:
    """CSV ledger with header, quoted line breaks and, possibly, a byte order mark; all text."""
    rows = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', encoding="UTF-8")
    rows = rows.toDF(*[c.lstrip("\ufeff") for c in rows.columns])
    return rows if ids is None else require_unique(rows.where(F.col(key).isin(*ids)), [key], "ledger ids")


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """One record per "\\n"; other Unicode line separators stay inside their record."""
    reader = spark.read.option("lineSep", "\n").option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def read_json_document(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True).option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Cases of a benchmark document, one row each."""
    return read_json_document(spark, path).select(F.explode("cases").alias("case")).select("case.*")
