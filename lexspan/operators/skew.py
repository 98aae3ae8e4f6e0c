"""Joins, top-k and grouping helpers that hold when one key owns a third of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

# A key with at least this many rows is hot. Only the MOST_HOT largest of them are broadcast,
# whatever the number of rows; the keys after them own less than one part in MOST_HOT each
# and go through the shuffle like any other.
HOT_ROWS, MOST_HOT = 1_000_000, 10_000


def attach_group_size(df: DataFrame, keys: Sequence[str], size: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Left-join each row with the number of rows that share its keys, where that is more
    than one; other rows, and rows with a NULL key, get NULL.

    Counting combines map-side, so a hot key costs one row per task. Joining the count
    back would send a hot key's rows to one task, so rows of hot keys take theirs from
    the broadcast table of hot keys and go through the shuffle spread by row hash.
    """
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(size)).where(F.col(size) > 1)
    for key in keys:
        sizes = sizes.where(F.col(key).isNotNull())
    return attach_by_key(df, sizes, keys, size, [size], hot_rows)


def attach_by_key(df: DataFrame, groups: DataFrame, keys: Sequence[str], size: str,
                  values: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Left-join per-key values from a table with one row per key that counts the rows of
    ``df`` with that key."""
    return _attach(df, _hottest(groups, keys, size, hot_rows), groups, keys, values)


def _hottest(groups: DataFrame, keys: Sequence[str], size: str, hot_rows: int) -> DataFrame:
    return groups.where(F.col(size) >= hot_rows).orderBy(F.desc(size), *keys).limit(MOST_HOT)


def lookup(df: DataFrame, dim: DataFrame, keys: dict[str, str], values: Sequence[str],
           hot_rows: int = HOT_ROWS) -> DataFrame:
    """Left-join values of a table with unique keys onto rows whose keys may be skewed.

    ``keys`` maps columns of ``df`` to columns of ``dim``. Keys that own at least
    ``hot_rows`` rows of ``df`` are joined by broadcast, also when ``dim`` lacks them.
    """
    named = dim.select(*[F.col(d).alias(k) for k, d in keys.items()], *values)
    names = list(keys)
    counts = df.groupBy(*names).agg(F.count(F.lit(1)).alias("__n"))
    for name in names:
        counts = counts.where(F.col(name).isNotNull())
    hot_keys = _hottest(counts, names, "__n", hot_rows).select(*names)
    hot = hot_keys.join(named.join(F.broadcast(hot_keys), names, "left_semi"), names, "left")
    return _attach(df, hot, named, names, values)


def _attach(df: DataFrame, hot: DataFrame, cold: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    hot = hot.select(*[F.col(k).alias(f"__hot_{k}") for k in keys],
                     *[F.col(v).alias(f"__hot_value_{v}") for v in values], F.lit(True).alias("__hot"))
    cold = cold.select(*[F.col(k).alias(f"__cold_{k}") for k in keys],
                       *[F.col(v).alias(f"__cold_value_{v}") for v in values], # Always 0, but not a constant the optimizer would take out of the join key.
                       F.pmod(F.xxhash64(*keys), F.lit(1).cast("long")).alias("__cold_spread"))
    marked = df.join(F.broadcast(hot), [F.col(k) == F.col(f"__hot_{k}") for k in keys], "left")
    no_key = F.lit(False)
    for key in keys:
        no_key = no_key | F.col(key).isNull()
    # Rows without a cold key get an odd hash as an extra join key: it spreads them over
    # the tasks and never equals the 0 of the cold side.
    apart = F.coalesce(F.col("__hot"), F.lit(False)) | no_key
    marked = marked.withColumn("__spread", F.when(
        apart, F.xxhash64(*[F.col(c) for c in df.columns]).bitwiseOR(F.lit(1).cast("long"))).otherwise(F.lit(0).cast("long")))
    joined = marked.join(cold, [F.col(k) == F.col(f"__cold_{k}") for k in keys]
                         + [F.col("__spread") == F.col("__cold_spread")], "left")
    return joined.select(*[F.col(c) for c in df.columns],
                         *[F.when(F.col("__hot"), F.col(f"__hot_value_{v}")).otherwise(F.col(f"__cold_value_{v}")).alias(v)
                           for v in values])


def ranked(df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str = "rank") -> DataFrame:
    """1-based position within each key. Use on lists that are already cut to a depth."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, name: str = "rank") -> DataFrame:
    """First ``k`` rows per key with their rank. The rank filter sits directly on the
    window, so each task keeps k rows per key before the shuffle."""
    return ranked(df, by, order, name).where(F.col(name) <= k)
