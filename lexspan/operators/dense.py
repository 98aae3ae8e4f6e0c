"""Exact vector search: inner products as matrix products inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lexspan.functions.vectors import dot, is_valid_vector
from lexspan.operators.skew import top_k

# Bytes of query vectors that one pass over the points may use in a task, and queries that are multiplied at a time.
PASS_BYTES, QUERY_BLOCK = 64 << 20, 1_024


def search_vector(points: DataFrame, vector: list[float], k: int, *, id_cols: list[str],
                  vector_col: str = "vector", where: Column | None = None,
                  decimals: int | None = None) -> DataFrame:
    """Top ``k`` points for one query vector; the filter applies before the cut. A vector of
    another length, or with a value that is not finite, is an error."""
    rows = points if where is None else points.where(where)
    score = F.when(is_valid_vector(vector_col, len(vector)), dot(vector_col, F.array(*[F.lit(float(x)) for x in vector]))).otherwise(
        F.raise_error(F.lit("invalid vector")))
    scored = rows.select(*id_cols, (F.round(score, decimals) if decimals is not None else score).alias("score"))
    return scored.orderBy(F.desc("score"), *id_cols).limit(k)


def search(points: DataFrame, queries: DataFrame, k: int, *, id_cols: list[str], vector_col: str = "vector",
           query_id: str = "query_id", query_vector: str = "query_vector", where: Column | None = None,
           decimals: int | None = None, block: int = QUERY_BLOCK, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """Top ``k`` points per query: query_id, id columns, score, rank.

    Queries stream through the driver in blocks; a task multiplies each batch of its points
    with one block after the other, so pairs are scored but never emitted. Its best rows of
    a block meet the batch's best ones in one sort, like rounds of a tournament. Up to
    ``pass_bytes`` of query vectors share one scan of the points; more take further scans.
    """
    rows = points if where is None else points.where(where)
    rows = rows.select(*id_cols, F.col(vector_col).alias("__vector"))
    kind, found = queries.schema[query_id].dataType, None
    for group in _passes(queries.select(F.col(query_id).alias("name"), F.col(query_vector).alias("vector")), block, pass_bytes):
        hits = _one_pass(rows, group, k, id_cols, kind, decimals)
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        empty = rows.select(F.lit(None).cast(kind).alias("query_id"), *id_cols, F.lit(0.0).alias("score"), F.lit(1).alias("rank"))
        return empty.where("false")
    return found


def _passes(queries: DataFrame, block: int, pass_bytes: int) -> Iterator[list]:
    """Groups of broadcast (names, matrix) blocks; the driver holds one block at a time."""
    context = queries.sparkSession.sparkContext
    group, names, vectors, used = [], [], [], 0

    def flush() -> None:
        matrix = np.array(vectors, dtype="float64").reshape(len(names), -1)
        if not np.isfinite(matrix).all():
            raise ValueError("query vectors must be finite")
        group.append(context.broadcast((list(names), matrix)))
        names.clear()
        vectors.clear()

    for row in queries.toLocalIterator():
        names.append(row["name"])
        vectors.append(row["vector"])
        used += 8 * len(row["vector"])
        if len(names) >= block:
            flush()
        if used >= pass_bytes:
            if names:
                flush()
            yield group
            group, used = [], 0
    if names:
        flush()
    if group:
        yield group


def _one_pass(rows: DataFrame, group: list, k: int, id_cols: list[str], kind: T.DataType, decimals: int | None) -> DataFrame:
    schema = T.StructType([T.StructField("query_id", kind)] + [rows.schema[c] for c in id_cols] + [T.StructField("score", T.DoubleType())])
    arrow_schema = to_arrow_schema(schema)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[pd.DataFrame | None] = [None] * len(group)
        for batch in batches:
            flat = np.asarray(batch.column("__vector").flatten(), dtype="float64")
            ids = batch.select(id_cols).to_pandas()
            for number, held in enumerate(group):
                names, matrix = held.value
                if flat.size != batch.num_rows * matrix.shape[1] or not np.isfinite(flat).all():
                    raise ValueError("vector dimension mismatch or non-finite value")
                best[number] = _better(best[number], flat.reshape(batch.num_rows, -1) @ matrix.T, ids, k, id_cols, decimals)
        for held, rows_ in zip(group, best, strict=True):
            if rows_ is not None:
                names = held.value[0]
                out = rows_.assign(query_id=[names[q] for q in rows_["__q"]])[arrow_schema.names]
                yield pa.RecordBatch.from_pandas(out, schema=arrow_schema, preserve_index=False)

    candidates = rows.mapInArrow(nearest, schema)
    return top_k(candidates, ["query_id"], [F.desc("score"), *[F.asc(c) for c in id_cols]], k)


def _better(best: pd.DataFrame | None, scores: np.ndarray, ids: pd.DataFrame, k: int, id_cols: list[str], decimals: int | None) -> pd.DataFrame:
    """The k best rows of each query of a block, from those so far and a batch's scores."""
    if decimals is not None:
        scores = np.round(scores, decimals)
    n = len(scores)
    # Everything tied with the k-th score stays until ids decide.
    least = np.partition(scores, n - k, axis=0)[n - k] if n > k else scores.min(axis=0, initial=np.inf)
    if best is not None:
        counts = best.groupby("__q")["score"].agg(["size", "min"])
        full = counts[counts["size"] >= k]
        least[full.index] = np.maximum(least[full.index], full["min"])
    queries_, rows = np.nonzero((scores >= least).T)
    found = ids.iloc[rows].assign(score=scores[rows, queries_], __q=queries_)
    if best is not None:
        found = pd.concat([best, found])
    ordered = found.sort_values(["__q", "score", *id_cols], ascending=[True, False, *[True] * len(id_cols)])
    return ordered.groupby("__q").head(k)


def centroids(points: DataFrame, key: str, vector_col: str = "vector") -> DataFrame:
    """Mean vector per key, combined map-side per (key, position)."""
    parts = points.select(key, F.posexplode(vector_col)).groupBy(key, "pos").agg(
        F.avg(F.col("col").cast("double")).alias("mean"))
    return parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "mean"))).alias("__parts")).select(
        F.col(key).alias("query_id"), F.transform("__parts", lambda p: p["mean"]).alias("query_vector"))
