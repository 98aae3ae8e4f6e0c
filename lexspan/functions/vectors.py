"""Vector checks and arithmetic on array columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from lexspan.functions.columns import as_col


def is_valid_vector(vector, dimension: int | None = None) -> Column:
    """Non-empty, finite in every place and, when asked, of the given dimension."""
    col = as_col(vector)
    finite = F.forall(col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    ok = (F.size(col) > 0) & finite
    if dimension is not None:
        ok = ok & (F.size(col) == dimension)
    return F.coalesce(ok, F.lit(False))


def dot(left, right) -> Column:
    return F.aggregate(F.zip_with(as_col(left), as_col(right), lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, x: acc + x)


def l2_normalize(vector) -> Column:
    col = as_col(vector)
    length = F.sqrt(dot(col, col))
    return F.transform(col, lambda x: x.cast("double") / F.greatest(length, F.lit(1e-12)))


def masked_mean(states, mask) -> Column:
    """Mean of the state vectors whose mask is set (array of arrays, array of ints)."""
    rows, keep = as_col(states), as_col(mask)
    width = F.size(F.get(rows, F.lit(0)))
    weighted = F.zip_with(rows, keep, lambda row, on: F.transform(row, lambda x: x.cast("double") * on))
    total = F.aggregate(weighted, F.array_repeat(F.lit(0.0), width),
                        lambda acc, row: F.zip_with(acc, row, lambda a, b: a + b))
    count = F.greatest(F.aggregate(keep, F.lit(0.0), lambda acc, on: acc + on), F.lit(1e-9))
    return F.transform(total, lambda x: x / count)
