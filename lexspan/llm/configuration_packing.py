"""Best-fit packing by a configuration linear program (operator 13).

Only the histogram of piece lengths matters for how many sequences are needed: at most
``SIZE`` numbers, whatever the size of the corpus. Its configuration program has a variable
for each way to fill a sequence and a row for each length:

    least sum of x[c],  with  sum of x[c] * copies(c, l) >= count(l)  for every length l

It is solved by multiplicative weights. A length's weight is its number of tokens (the
prices of a perfect packing) times a factor that shrinks by ``exp(-rate)`` as the length
goes from uncovered to covered. Each phase solves one knapsack over all capacities by
dynamic programming, which prices all configurations: the best one that holds a given
length is this length and the best filling of what it leaves. Every configuration within
``SLACK`` of the best one whose lengths no other has taken in this phase gets a step of
``STEP`` of the scarcest length in it, then the weights change. The solution is rounded
down, fractions are rounded up while their pieces last, and the pieces that are left are
packed largest first with the subset of the rest that fills the sequence best. Of the
solutions of two rates and the roundings of each (configurations with gaps of at most some
tokens) the shortest counts.

Pieces of equal length are interchangeable, so a packing is a few thousand segments "these
ranks of this length stand at this offset of these sequences". A piece's rank is its place
in its task and the counts of the tasks before; the tasks look the segments up.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from lexspan.llm.common import cut_lineage
from lexspan.llm.packing import encoder

SIZE, END = 1024, 2
STEP, SLACK = 0.05, 0.05
RATES = (0.3, 4.0)  # slow keeps near the prices of a perfect packing, fast leaves them where none exists
GAPS = (2, 10, SIZE)  # tokens that a rounded configuration may leave free

Configuration = tuple[tuple[int, int], ...]  # (length, copies), ascending

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, block int, before long"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def knapsack(lengths: np.ndarray, values: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Best value and last item (-1: none) for every capacity; items may repeat."""
    best, last = np.zeros(size + 1), np.full(size + 1, -1, dtype=np.int64)
    usable = np.searchsorted(lengths, np.arange(size + 1), side="right")
    for capacity in range(int(lengths[0]), size + 1):
        found = best[capacity - lengths[:usable[capacity]]] + values[:usable[capacity]]
        item = int(found.argmax())
        best[capacity] = max(found[item], best[capacity - 1])
        if found[item] > best[capacity - 1]:
            last[capacity] = item
    return best, last


def _filling(lengths: list[int], last: list[int], capacity: int) -> dict[int, int]:
    """The copies of each length in the best filling of a capacity."""
    copies: dict[int, int] = {}
    while capacity > 0:
        if last[capacity] < 0:
            capacity -= 1
        else:
            length = lengths[last[capacity]]
            copies[length] = copies.get(length, 0) + 1
            capacity -= length
    return copies


def solve(counts: np.ndarray, rate: float, size: int = SIZE) -> dict[Configuration, float]:
    """A fractional solution: how often each configuration is used. ``counts[l]`` pieces have length l."""
    need, covered = counts.astype(float), np.zeros(size + 1)
    used: dict[Configuration, float] = {}
    while len(lengths := np.flatnonzero(covered < need * (1 - 1e-9))):
        share = covered[lengths] / need[lengths]
        values = lengths * np.exp(-rate * (share - share.min()))
        best, last = knapsack(lengths, values, size)
        good = np.flatnonzero(values + best[size - lengths] >= (1 - SLACK) * best[size])
        names, choices, taken = lengths.tolist(), last.tolist(), set()
        for k in good[np.argsort(share[good], kind="stable")].tolist():
            if names[k] in taken:
                continue
            copies = _filling(names, choices, size - names[k])
            copies[names[k]] = copies.get(names[k], 0) + 1
            if taken.isdisjoint(copies):
                step = min(min(STEP * need[n], need[n] - covered[n]) / c for n, c in copies.items())
                key = tuple(sorted(copies.items()))
                used[key] = used.get(key, 0.0) + step
                for n, c in copies.items():
                    covered[n] += step * c
                taken.update(copies)
    return used


def _best_subset(rest: np.ndarray, room: int) -> list[int]:
    """Lengths that fill the room as far as the rest can; sums are the bits of one integer."""
    reach, items, mask = [1], [], (1 << (room + 1)) - 1
    for length in np.flatnonzero(rest[:room + 1])[::-1].tolist():
        for _ in range(min(int(rest[length]), room // length)):
            more = reach[-1] | (reach[-1] << length) & mask
            if more == reach[-1]:
                break
            reach.append(more)
            items.append(length)
        if reach[-1] >> room & 1:
            break
    total, chosen = reach[-1].bit_length() - 1, []
    for k in range(len(items) - 1, -1, -1):
        if not reach[k] >> total & 1:
            chosen.append(items[k])
            total -= items[k]
    return chosen


def round_solution(counts: np.ndarray, used: dict[Configuration, float], gap: int, size: int = SIZE) -> list[tuple[Configuration, int]]:
    """Whole numbers of sequences of each configuration, all pieces placed once."""
    rest = counts.astype(np.int64)
    rows: list[tuple[Configuration, int]] = []

    def take(configuration: Configuration, times: int) -> None:
        for length, copies in configuration:
            rest[length] -= copies * times
        rows.append((configuration, times))

    good = [(c, x, int(x + 1e-9)) for c, x in used.items() if size - sum(n * k for n, k in c) <= gap]
    for configuration, _, whole in good:
        if whole:
            take(configuration, whole)
    for configuration, _, _ in sorted(good, key=lambda row: row[2] - row[1]):
        if all(rest[length] >= copies for length, copies in configuration):
            take(configuration, 1)
    while rest.any():
        largest = int(np.flatnonzero(rest)[-1])
        rest[largest] -= 1
        content = [largest, *_best_subset(rest, size - largest)]
        rest[largest] += 1
        lengths, copies = np.unique(content, return_counts=True)
        take(tuple(zip(lengths.tolist(), copies.tolist(), strict=True)), int((rest[lengths] // copies).min()))
    return rows


def plan(counts: np.ndarray, size: int = SIZE) -> list[tuple[Configuration, int]]:
    """The rounded solution with the fewest sequences."""
    solutions = [solve(counts, rate, size) for rate in RATES]
    return min((round_solution(counts, used, gap, size) for used in solutions for gap in GAPS), key=lambda rows: sum(n for _, n in rows))


class Segments:
    """For each length, which ranks stand in which sequences at which offset; arrays by length, then first rank."""

    def __init__(self, rows: list[tuple[Configuration, int]], size: int = SIZE):
        ranks, found, sequence = [0] * (size + 1), [], 0
        for configuration, times in rows:
            offset = 0
            for length, copies in configuration:
                for _ in range(copies):
                    found.append((length, ranks[length], sequence, offset))
                    ranks[length] += times
                    offset += length
            sequence += times
        table = np.array(sorted(found), dtype=np.int64).reshape(-1, 4)
        self.key, self.first, self.sequence, self.offset = self._key(table[:, 0], table[:, 1]), table[:, 1], table[:, 2], table[:, 3]

    @staticmethod
    def _key(length: np.ndarray, rank: np.ndarray) -> np.ndarray:
        return (length << 48) + rank  # lengths below 2**15, ranks below 2**48

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.key, self._key(length, rank), side="right") - 1
        return self.sequence[at] + rank - self.first[at], self.offset[at]


def cut(n_tokens: int, size: int = SIZE) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all of ``size`` tokens but the first."""
    first = n_tokens % size or size
    return [(0, first)] + [(start, size) for start in range(first, n_tokens, size)]


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """The pieces of every document, each with its place among its task's pieces of its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        block, encode, seen = TaskContext.get().partitionId(), encoder(tokenizer), np.zeros(size + 1, np.int64)
        end = np.array([END], "<u4").tobytes()
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                out: list[list] = [[] for _ in types]
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    view = memoryview(encode.ids(text).astype("<u4").tobytes() + end)
                    for piece, (start, length) in enumerate(cut(len(view) // 4, size)):
                        row = (doc_id, piece, start, length, zlib.crc32(view[4 * start:4 * (start + length)]), block, int(seen[length]))
                        seen[length] += 1
                        for column, value in zip(out, row, strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], [f.split()[0] for f in PIECES.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, PIECES)


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """One row per piece: its document, its tokens, and its place in a sequence of at most ``size`` tokens.

    A document is its ids and the id 2; one of more than ``size`` tokens is cut into pieces of
    ``size``, the first of which may be shorter. A null or empty text is the one id 2; rows
    with null or repeated ids are documents of their own; other columns are not read; an empty
    table gives no rows. The histogram of lengths (``size`` rows) is all that passes the driver,
    and the segments of the packing (some thousands) all that is broadcast.
    """
    spark = docs.sparkSession
    # Written once: ranks and their bases must come from the same tasks.
    cut_up = cut_lineage(pieces(docs, tokenizer, id_col, text_col, size))
    sums = cut_up.groupBy("block", "length").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("block", "length", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    counts = np.zeros(size + 1, dtype=np.int64)
    for row in cut_up.groupBy("length").agg(F.count("*").alias("n")).collect():
        counts[row["length"]] = row["n"]
    held = spark.sparkContext.broadcast(Segments(plan(counts, size), size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = held.value.place(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], [f.split()[0] for f in PLACED.split(", ")])

    placed = cut_up.join(bases, ["block", "length"])
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("before")).alias("rank")).mapInArrow(run, PLACED)
