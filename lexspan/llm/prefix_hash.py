"""Document fingerprints by prefix polynomial hashes (operator 5).

A text's code points give prefix arrays modulo two primes. Any two spans are compared in
constant time by their normalised differences, and the longest common extension of two
positions is found by binary search, because equality of extensions is monotone.

A fingerprint holds samples of those arrays: the length, the hash of the whole text and
the hashes of the prefixes and suffixes whose length is a multiple of a power of two that
leaves fewer than ``SAMPLES`` of them. Steps are powers of two, so the samples of any two
fingerprints meet on the larger step. The likeness of two fingerprints is the longest
common prefix plus the longest common suffix that the samples prove, over the longer
length: 1 for equal texts, at most 1/16 below the share of text in front of and behind a
single edited region.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, functions as F

from lexspan.llm.common import shuffle_partitions

PRIMES = ((1 << 31) - 1, (1 << 31) - 19)
BASES = (1_103_515_245, 1_566_083_941)
SAMPLES = 32

_tables: list[tuple[np.ndarray, np.ndarray]] = []


def _power_tables(size: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Powers and inverse powers of the bases up to ``size``, doubled when they run out."""
    if not _tables or len(_tables[0][0]) <= size:
        length = max(1 << 14, 1 << int(size + 1).bit_length())
        _tables.clear()
        for prime, base in zip(PRIMES, BASES, strict=True):
            pair = []
            for factor in (base, pow(base, -1, prime)):
                row = np.ones(1, dtype=np.uint64)
                while len(row) < length:
                    row = np.concatenate([row, row * np.uint64(pow(factor, len(row), prime)) % np.uint64(prime)])
                pair.append(row)
            _tables.append((pair[0], pair[1]))
    return _tables


class PrefixHashes:
    """Prefix arrays of one text; positions are code points."""

    def __init__(self, text: str):
        codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
        self.length = len(codes)
        self.prefixes = []
        for (powers, _), prime in zip(_power_tables(self.length), PRIMES, strict=True):
            row = np.zeros(self.length + 1, dtype=np.uint64)
            np.cumsum(codes * powers[:self.length] % np.uint64(prime), out=row[1:])
            self.prefixes.append(row % np.uint64(prime))

    def spans(self, starts, ends, which: int) -> np.ndarray:
        """Hashes of spans under one of the primes; equal spans have equal hashes."""
        prime, row = np.uint64(PRIMES[which]), self.prefixes[which]
        starts = np.asarray(starts)
        return (row[ends] + prime - row[starts]) % prime * _power_tables(self.length)[which][1][starts] % prime

    def span(self, start: int, end: int) -> tuple[int, ...]:
        return tuple(int(self.spans(start, end, which)) for which in range(len(PRIMES)))

    def equal(self, start: int, other: PrefixHashes, other_start: int, length: int) -> bool:
        return self.span(start, start + length) == other.span(other_start, other_start + length)

    def common_extension(self, start: int, other: PrefixHashes, other_start: int) -> int:
        """Length of the longest common run of code points from the two positions on."""
        low, high = 0, min(self.length - start, other.length - other_start)
        while low < high:
            middle = (low + high + 1) // 2
            if self.equal(start, other, other_start, middle):
                low = middle
            else:
                high = middle - 1
        return low

    def fingerprint(self) -> str:
        step = 1
        while self.length // step >= SAMPLES:
            step *= 2
        marks = np.arange(step, self.length + 1, step)
        fronts = self.prefixes[0][marks]
        backs = self.spans(self.length - marks, np.full(len(marks), self.length), 0)
        whole = "".join(f"{part:08x}" for part in self.span(0, self.length))
        return (f"{self.length:x}:{whole}:{step:x}:" + "".join(map("{:08x}".format, fronts.tolist()))
                + ":" + "".join(map("{:08x}".format, backs.tolist())))


def _shared(mine: str, my_stride: int, other: str, other_stride: int) -> int:
    """Number of leading samples, on the larger step, that agree."""
    low, high = 0, min(len(mine) // 8 // my_stride, len(other) // 8 // other_stride)
    while low < high:
        middle = (low + high + 1) // 2
        a, b = middle * my_stride * 8, middle * other_stride * 8
        if mine[a - 8:a] == other[b - 8:b]:
            low = middle
        else:
            high = middle - 1
    return low


def likeness(first: str, second: str) -> float:
    """Likeness of two fingerprints, 0 to 1; 1 for the fingerprints of equal texts."""
    if first == second:
        return 1.0
    n, _, step, fronts, backs = first.split(":")
    m, _, other_step, other_fronts, other_backs = second.split(":")
    n, m, step, other_step = (int(x, 16) for x in (n, m, step, other_step))
    if not n or not m:
        return 0.0
    wide = max(step, other_step)
    strides = wide // step, wide // other_step
    front = _shared(fronts, strides[0], other_fronts, strides[1]) * wide
    back = _shared(backs, strides[0], other_backs, strides[1]) * wide
    return min(front + back, min(n, m)) / max(n, m)


def in_order_with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (bucket, trailer, id, text): ids cut into ranges, one bucket each, and behind
    every bucket, as a trailer, a copy of the row that follows its last row. Behind the
    last bucket that is the first row of all. Each text moves once; only the first row of
    a bucket, as many as there are shuffle partitions, moves twice."""
    spark = docs.sparkSession
    count = shuffle_partitions(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    rows = rows.withColumn("__at", F.coalesce(F.col("__id").cast("double"), F.lit(float("-inf"))))
    bounds = rows.where(F.col("__id").isNotNull()).approxQuantile("__at", [k / count for k in range(1, count)], 0.25 / count) if count > 1 else []
    splits = [float("-inf"), *sorted({float(b) for b in bounds}), float("inf")]
    marked = Bucketizer(splits=splits, inputCol="__at", outputCol="__bucket").transform(rows) if len(splits) > 2 \
        else rows.withColumn("__bucket", F.lit(0.0))
    marked = marked.select(F.col("__bucket").cast("int").alias("bucket"), F.col("__id").alias("id"), F.col("__text").alias("text"),
                           F.xxhash64("__text").alias("tie"))
    firsts = marked.groupBy("bucket").agg(F.min(F.struct(F.coalesce("id", F.lit(-(1 << 63))).alias("order"), "tie", "id")).alias("first"))
    found = sorted((r["bucket"], r["first"]["id"], r["first"]["tie"]) for r in firsts.collect())  # a row per bucket
    targets = [(found[k][1], found[k][2], found[k - 1][0]) for k in range(len(found))]
    ahead = spark.createDataFrame(targets, "__first long, __tie long, target int")
    joined = marked.join(F.broadcast(ahead), F.col("id").eqNullSafe(F.col("__first")) & (F.col("tie") == F.col("__tie")), "left")
    own = F.struct(F.col("bucket"), F.lit(False).alias("trailer"))
    copies = F.when(F.col("target").isNull(), F.array(own)).otherwise(
        F.array(own, F.struct(F.col("target").alias("bucket"), F.lit(True).alias("trailer"))))
    dealt = joined.select(F.explode(copies).alias("place"), "id", "tie", "text")
    return (dealt.select("place.bucket", "place.trailer", "id", "tie", "text").repartition(count, "bucket")
            .sortWithinPartitions("bucket", "trailer", F.col("id").asc_nulls_first(), "tie").drop("tie"))


RESULT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [field.split()[0] for field in RESULT.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    held = None  # the row whose next one has not come yet
    for batch in batches:
        out: list[tuple] = []
        for bucket, trailer, doc_id, text in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            mark = PrefixHashes(text).fingerprint()
            if held is not None and held[0] == bucket:
                _, own_id, own, own_mark = held
                cut = len(own) // 4
                edited = own[:len(own) - cut] + text[:cut]
                edited_mark = own_mark if edited == own else PrefixHashes(edited).fingerprint()
                out.append((own_id, len(own), hashlib.sha256(edited.encode()).hexdigest(), own_mark, edited_mark,
                            likeness(own_mark, edited_mark), likeness(own_mark, mark)))
            held = None if trailer else (bucket, doc_id, text, mark)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of every text, of its edited text and their likeness.

    The edited text has the last quarter of the code points replaced by as many first ones
    (or all) of the next document by ascending id; after the last comes the first. A null
    text counts as empty, a null id comes first, rows of one id are ordered by a hash of
    their text (repeated rows stand next to each other), and an empty table gives no rows.
    Other columns are not read.
    """
    return in_order_with_next(docs, id_col, text_col).mapInArrow(_compare, RESULT)


def fingerprint_column(texts: Iterator) -> Iterator:
    """Body of a pandas UDF ``text -> fingerprint`` for callers that need only that."""
    for series in texts:
        yield series.fillna("").map(lambda text: PrefixHashes(text).fingerprint())
