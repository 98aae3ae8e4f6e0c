"""Words, lines and their hashes for whole Arrow batches of texts, as numpy arrays.

A batch is cut into slices of whole texts of about ``SLICE_BYTES``, so that the arrays of
a task stay small however long the batch is; one longer text is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 21

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE_VALUES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    ones = np.ones(1, dtype=np.uint64)
    return (np.concatenate([ones, np.cumprod(np.full(size, _BASE))]),
            np.concatenate([ones, np.cumprod(np.full(size, _INVERSE))]))


def mix(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits, one to one."""
    x = values ^ (values >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    large = pa.types.is_large_string(column.type)
    _, offset_buffer, data_buffer = column.buffers()
    rows = len(column)
    if not rows:
        return
    offsets = np.frombuffer(offset_buffer, dtype=np.int64 if large else np.int32)
    offsets = offsets[column.offset:column.offset + rows + 1].astype(np.int64)
    data = np.frombuffer(data_buffer, dtype=np.uint8) if data_buffer is not None else np.zeros(0, np.uint8)
    at = 0
    while at < rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield at, end, data[offsets[at]:offsets[end]], offsets[at:end + 1] - offsets[at]
        at = end


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every run of bytes other than ASCII white space."""
    solid = ~SPACE[data]
    before = np.zeros(len(data), dtype=bool)
    before[1:] = solid[:-1]
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    after = np.zeros(len(data), dtype=bool)
    after[:-1] = solid[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts = np.flatnonzero(solid & ~before)
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, equal for equal bytes wherever they stand."""
    size = max(SLICE_BYTES, len(data))
    powers, inverses = _powers(1 << int(size - 1).bit_length())
    prefix = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_VALUES[data] * powers[:len(data)], out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * inverses[starts] + (ends - starts).astype(np.uint64))


def shingle_hashes(words: np.ndarray, texts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every run of ``size`` words; a text of fewer words, but one
    at least, has its whole sequence as its one shingle. ``texts`` is in order."""
    factors = mix(np.arange(1, size + 1, dtype=np.uint64)) | np.uint64(1)
    full = max(0, len(words) - size + 1)
    values = np.full(full, np.uint64(size))
    for k in range(size):
        values += words[k:k + full] * factors[k]
    inside = texts[:full] == texts[size - 1:]
    hashes, owners = [mix(values[inside])], [texts[:full][inside]]
    firsts = np.flatnonzero(np.diff(texts, prepend=-1))
    counts = np.diff(np.append(firsts, len(texts)))
    for first, count in zip(firsts[counts < size], counts[counts < size], strict=True):
        total = np.sum(words[first:first + count] * factors[:count]) + np.uint64(count)
        hashes.append(mix(np.array([total], dtype=np.uint64)))
        owners.append(texts[first:first + 1])
    return np.concatenate(hashes), np.concatenate(owners)


def sorted_distinct(values: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (owner, value) pairs ordered by owner, then value."""
    order = np.lexsort((values, owners))
    values, owners = values[order], owners[order]
    new = np.ones(len(values), dtype=bool)
    new[1:] = (values[1:] != values[:-1]) | (owners[1:] != owners[:-1])
    return values[new], owners[new]
