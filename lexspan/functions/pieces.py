"""Python functions of rows, over bounded pieces of Spark's Arrow batches.

A batch has up to 10,000 rows of any size. Its rows become Python objects, and these results,
a piece at a time, and every piece's results are a batch of their own: what a task holds
beside the batch does not grow with it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import functions as F, types as T

# Arrow bytes of a piece; as Python objects they may take ten times as much.
PIECE_BYTES = 1 << 20

_ATOMS = {T.StringType(): pa.string(), T.IntegerType(): pa.int32(), T.BooleanType(): pa.bool_()}


def arrow_type(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(arrow_type(kind.elementType))
    if isinstance(kind, T.StructType):
        return pa.struct([(field.name, arrow_type(field.dataType)) for field in kind.fields])
    return _ATOMS[kind]


def pieces(columns: tuple[pa.Array, ...], limit: int = PIECE_BYTES) -> Iterator[tuple[pa.Array, ...]]:
    """The rows of the columns, in order, in slices of at most ``limit`` bytes or a single row."""
    rows = len(columns[0])
    if rows > 1 and sum(column.nbytes for column in columns) > limit:
        yield from pieces(tuple(column.slice(0, rows // 2) for column in columns), limit)
        yield from pieces(tuple(column.slice(rows // 2) for column in columns), limit)
    elif rows:
        yield columns


def row_function(kind: T.DataType, function: Callable):
    """A Column function that calls a Python function for every row, with None for NULL."""
    result = arrow_type(kind)

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for batch in batches:
            for columns in pieces(batch if isinstance(batch, tuple) else (batch,)):
                yield pa.array(map(function, *(column.to_pylist() for column in columns)), result)

    return F.arrow_udf(run, kind)
