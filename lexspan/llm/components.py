"""Connected components of an edge table, by rounds of star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lexspan.llm.common import cut_lineage

# Edges a task writes: tables of a few thousand links are not kept in a file per shuffle partition.
ROWS_PER_TASK = 250_000


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], int(row["s"] or 0)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of an edge table (a, b) of longs; the component is
    the smallest node that links reach. Each round hangs the larger neighbours of a node,
    then the smaller ones, on its least neighbour; rounds grow with the logarithm of the
    number of nodes. Every round is a written table; nothing is gathered at the driver.
    Earlier results may be among the edges, as (node, component): they need no more rounds."""
    flat = cut_lineage(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(flat)
    while state[0]:
        both = flat.unionByName(flat.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .where("a != b").distinct())
        parent = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(parent, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")),
                                                                F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        flat = cut_lineage(small.select("e.a", "e.b").where("a != b").select(
            F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().coalesce(-(-state[0] // ROWS_PER_TASK)))
        last, state = state, _state(flat)
        if state == last:
            break
    # What no round changes is stars: one row for each node that is not the least of its component.
    return flat.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        flat.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
