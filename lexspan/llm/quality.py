"""Quality rules (operator 7): fixed counts, and a hashed n-gram logistic regression.

Words (one and two in a row) and character trigrams are hashed into one weight table. A
text's score is the mean weight of its word grams plus the mean weight of its character
grams plus a bias, so any length is scored by table look-ups over an Arrow batch. The
weights are fitted on labelled quality rows, a sigmoid fitted on other labelled rows makes
the score a probability, and a fixed threshold decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lexspan.llm import bytespans as B

# Bound of the labelled sample: rows used for fitting, and for calibration.
FIT_ROWS, CALIBRATION_ROWS = 3_000, 1_500
HASH_BITS = 18
# Entries of the sample whose products the fit holds at a time.
FIT_ENTRIES = 1 << 17
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
MIN_PROBABILITY = 0.5

SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
RESULT = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean, probability double, kept boolean")


@dataclass
class Model:
    """Weights by hash, bias, and slope and offset of the calibration."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float


def grams(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, words: np.ndarray, texts: np.ndarray):
    """(bucket, text number) of the word grams and of the character grams."""
    shift = np.uint64(64 - HASH_BITS)
    pair = texts[:-1] == texts[1:]
    pairs = B.mix(words[:-1][pair] * np.uint64(0x9E3779B97F4A7C15) + words[1:][pair])
    word_part = (np.concatenate([words, pairs]) >> shift).astype(np.int64), np.concatenate([texts, texts[:-1][pair]])
    size = max(0, len(data) - 2)
    wide = data.astype(np.uint64)
    code = (wide[:size] << np.uint64(16)) | (wide[1:size + 1] << np.uint64(8)) | wide[2:size + 2]
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = owner[:size] == owner[2:size + 2]
    return word_part, ((B.mix(code[inside] + np.uint64(7)) >> shift).astype(np.int64), owner[:size][inside])


def base_counts(data, offsets, starts, ends, words, texts) -> dict[str, np.ndarray]:
    """The fixed counts of every text of a slice."""
    n = len(offsets) - 1
    count = lambda owners, weights=None: np.bincount(owners, weights, n).astype(np.int64)
    # Code points are the bytes that do not continue one.
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    at = np.flatnonzero(SYMBOLS[data])
    result = {"n_words": count(texts), "word_chars": count(texts, points[ends] - points[starts]),
              "n_symbols": count(np.searchsorted(offsets, at, side="right") - 1)}
    # Lines end at a line feed and at the end of their text.
    breaks = np.flatnonzero(data == 10)
    line_starts = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], breaks + 1]))
    line_starts = line_starts[line_starts < len(data)]
    owners = np.searchsorted(offsets, line_starts, side="right") - 1
    next_break = np.searchsorted(breaks, line_starts)
    line_ends = np.minimum(np.append(breaks, len(data))[next_break], offsets[owners + 1])
    worded = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    lines = B.span_hashes(data, line_starts[worded], line_ends[worded]) if worded.any() else np.zeros(0, np.uint64)
    distinct = B.sorted_distinct(lines, owners[worded])[1]
    result["n_dup_lines"] = count(owners[worded]) - count(distinct)
    # Words covered by a window of three that its text has twice or more.
    marked = np.zeros(len(words), dtype=bool)
    if len(words) >= 3:
        first = np.flatnonzero(texts[:-2] == texts[2:])
        window = B.mix(words[first] * np.uint64(3) + B.mix(words[first + 1] * np.uint64(5) + B.mix(words[first + 2])))
        order = np.lexsort((window, texts[first]))
        value, owner = window[order], texts[first][order]
        same = (value[1:] == value[:-1]) & (owner[1:] == owner[:-1])
        twice = np.zeros(len(order), dtype=bool)
        twice[1:] |= same
        twice[:-1] |= same
        for k in range(3):
            marked[first[order[twice]] + k] = True
    result["n_repeat_words"] = count(texts[marked])
    return result


def _slices(column: pa.Array):
    for first, end, data, offsets in B.slices(column):
        starts, ends, texts = B.word_spans(data, offsets)
        words = B.span_hashes(data, starts, ends) if len(starts) else np.zeros(0, np.uint64)
        yield first, end, data, offsets, starts, ends, texts, words


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sparse rows for the fit: distinct buckets and their share of the text's grams."""
    for batch in batches:
        labels, splits = batch.column("label").to_pylist(), batch.column("part").to_pylist()
        out = []
        for first, end, data, offsets, starts, _, texts, words in _slices(batch.column("text")):
            parts = grams(data, offsets, starts, words, texts)
            for k in range(end - first):
                buckets, values = [], []
                for bucket, owner in parts:
                    own, times = np.unique(bucket[owner == k], return_counts=True)
                    buckets.append(own)
                    values.append(times / max(1, times.sum()))
                out.append((labels[first + k], splits[first + k], np.concatenate(buckets).astype(np.int32).tobytes(),
                            np.concatenate(values).astype(np.float32).tobytes()))
        if out:
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()),
                                              pa.array(columns[2], pa.binary()), pa.array(columns[3], pa.binary())],
                                             ["label", "part", "buckets", "shares"])


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _cuts(counts: np.ndarray, limit: int = FIT_ENTRIES) -> Iterator[tuple[slice, slice]]:
    """(owners, their entries) in runs of at most ``limit`` entries or a single owner."""
    ends, at = np.concatenate([[0], np.cumsum(counts)]), 0
    while at < len(counts):
        end = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, side="right")) - 1)
        yield slice(at, end), slice(ends[at], ends[end])
        at = end


def _fit_weights(rows: list, steps: int = 120, rate: float = 1.0, decay: float = 1e-6) -> tuple[np.ndarray, float]:
    """Weighted logistic loss by full-batch Adagrad; both classes carry the same total weight.

    The entries are held in order of rows, for the margins, and in order of columns, for the
    slopes, 20 bytes in all; products of them exist for a piece at a time."""
    columns, shares = (np.concatenate([r[k] for r in rows]) for k in (1, 2))
    sizes, of_column = np.array([len(r[1]) for r in rows]), np.bincount(columns, minlength=1 << HASH_BITS)
    order = np.argsort(columns, kind="stable").astype(np.int32)
    column_rows, column_shares = np.repeat(np.arange(len(rows), dtype=np.int32), sizes)[order], shares[order]
    del order
    by_row, by_column = list(_cuts(sizes)), list(_cuts(of_column))
    y = np.array([r[0] for r in rows], dtype=np.float64)
    balance = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    weights, bias, seen, seen_bias = np.zeros(1 << HASH_BITS), 0.0, np.full(1 << HASH_BITS, 1e-12), 1e-12
    margin, slope = np.zeros(len(rows)), np.zeros(1 << HASH_BITS)

    def sums(into: np.ndarray, pieces: list, counts: np.ndarray, products) -> None:
        for owners, part in pieces:
            n = owners.stop - owners.start
            into[owners] = np.bincount(np.repeat(np.arange(n), counts[owners]), products(part), n)

    for _ in range(steps):
        sums(margin, by_row, sizes, lambda part: weights[columns[part]] * shares[part])
        error = (_sigmoid(margin + bias) - y) * balance
        sums(slope, by_column, of_column, lambda part, error=error: error[column_rows[part]] * column_shares[part])
        slope += decay * weights
        seen += slope ** 2
        seen_bias += error.sum() ** 2
        weights -= rate * slope / np.sqrt(seen)
        bias -= 0.1 * error.sum() / np.sqrt(seen_bias)
    return weights, bias


def _fit_sigmoid(scores: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton steps, towards smoothed targets."""
    good, bad = y.sum(), len(y) - y.sum()
    target = np.where(y == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    slope, offset = 1.0, 0.0
    for _ in range(50):
        p = _sigmoid(slope * scores + offset)
        gap, weight = target - p, np.maximum(p * (1 - p), 1e-9)
        gradient = np.array([(gap * scores).sum() - 1e-3 * slope, gap.sum()])
        hessian = np.array([[(weight * scores ** 2).sum() + 1e-3, (weight * scores).sum()], [(weight * scores).sum(), weight.sum() + 1e-9]])
        step = np.linalg.solve(hessian, gradient)
        step *= min(1.0, 5.0 / max(1e-9, np.abs(step).max()))
        slope, offset = slope + step[0], offset + step[1]
    return float(slope), float(offset)


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The model of all rows, as a row; none where they lack one of the classes."""
    rows = []
    for batch in batches:
        # The rows stay in Arrow's buffers; arrays of them are views.
        values = [[np.frombuffer(v.as_buffer(), kind) for v in batch.column(name)] for name, kind in (("buckets", np.int32), ("shares", np.float32))]
        rows += zip(batch.column("label").to_pylist(), *values, batch.column("part").to_pylist(), strict=True)
    rows.sort(key=lambda r: (r[3], r[0], len(r[1]), r[1].tobytes(), r[2].tobytes()))
    fitting, held = [r for r in rows if r[3] == 0], [r for r in rows if r[3] == 1]
    if len({r[0] for r in fitting}) < 2:
        return
    weights, bias = _fit_weights(fitting)
    held = held if len({r[0] for r in held}) == 2 else fitting
    scores = np.array([weights[r[1]] @ r[2] + bias for r in held])
    slope, offset = _fit_sigmoid(scores, np.array([r[0] for r in held], dtype=np.float64))
    yield pa.RecordBatch.from_pydict({"weights": [weights.astype(np.float32).tobytes()], "bias": [float(bias)], "slope": [slope], "offset": [offset]})


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        fit_rows: int = FIT_ROWS, calibration_rows: int = CALIBRATION_ROWS) -> Model | None:
    """Model from at most ``fit_rows + calibration_rows`` labelled rows, those with the
    smallest hash of their id. None where the sample lacks one of the classes. One task fits
    the rows of the sample; the driver is sent the model alone."""
    total = fit_rows + calibration_rows
    chosen = (labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
              .select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("label"))
              .orderBy(F.xxhash64(F.col("__id").cast("string"), F.lit(17)), "__id", "label").limit(total))
    # At most ``total`` rows of (id, label): small by construction.
    part = (F.pmod(F.xxhash64(F.col("__id").cast("string"), F.lit(29)), F.lit(total)) >= fit_rows).cast("int")
    sample = docs.join(F.broadcast(chosen), F.col(id_col) == F.col("__id")).select("label", part.alias("part"), F.col(text_col).alias("text"))
    found = (sample.mapInArrow(_features, "label int, part int, buckets binary, shares binary").limit(total).coalesce(1)
             .mapInArrow(_fitted, "weights binary, bias double, slope double, offset double").collect())
    return Model(np.frombuffer(found[0]["weights"], np.float32), *found[0][1:]) if found else None


def score(model: Model, data, offsets, starts, words, texts) -> np.ndarray:
    """Probability of good quality of every text of a slice."""
    n = len(offsets) - 1
    total = np.full(n, model.bias)
    for bucket, owner in grams(data, offsets, starts, words, texts):
        total += np.bincount(owner, model.weights[bucket], n) / np.maximum(1, np.bincount(owner, minlength=n))
    return _sigmoid(model.slope * total + model.offset)


def assess(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           min_probability: float = MIN_PROBABILITY, model: Model | None = None) -> DataFrame:
    """Counts, rule verdict, probability and final verdict of every document.

    A null or empty text has no words and fails the rules. Rows with a null or repeated id
    are assessed like any other; labels that are null or neither 0 nor 1 are not used, and
    an id with several labels counts once for each. Without labels of both classes the
    probability is null and the rules alone decide. An empty table gives no rows. Other
    columns are not read.
    """
    model = model or fit(docs, labels, id_col, text_col)
    held = docs.sparkSession.sparkContext.broadcast(model)  # one table of 2^HASH_BITS weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = held.value
        for batch in batches:
            columns: dict[str, list] = {}
            for _, _, data, offsets, starts, ends, texts, words in _slices(batch.column("text")):
                counts = base_counts(data, offsets, starts, ends, words, texts)
                failed = (counts["n_words"] < MIN_WORDS) | (100 * counts["n_repeat_words"] > MAX_REPEAT_PERCENT * counts["n_words"])
                counts["base_failed"] = failed
                p = score(fitted, data, offsets, starts, words, texts) if fitted else np.full(len(failed), np.nan)
                counts["probability"] = p
                counts["kept"] = ~failed & ~(p < min_probability)
                for name, values in counts.items():
                    columns.setdefault(name, []).append(values)
            if columns:
                arrays = {name: pa.array(np.concatenate(parts), from_pandas=True) for name, parts in columns.items()}
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays.values()], ["doc_id", *arrays])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, RESULT)


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, with their columns. A row is matched by its id and
    the hash of its text, so repeated rows stay as they are."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.withColumn("__text_hash", F.xxhash64(text))
    model = fit(docs, labels, id_col, text_col)
    held = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = held.value
        for batch in batches:
            kept = []
            for _, _, data, offsets, starts, ends, texts, words in _slices(batch.column(batch.schema.get_field_index(text_col))):
                counts = base_counts(data, offsets, starts, ends, words, texts)
                failed = (counts["n_words"] < MIN_WORDS) | (100 * counts["n_repeat_words"] > MAX_REPEAT_PERCENT * counts["n_words"])
                if fitted:
                    failed |= score(fitted, data, offsets, starts, words, texts) < MIN_PROBABILITY
                kept.append(~failed)
            if kept:
                yield batch.filter(pa.array(np.concatenate(kept)))

    return keyed.select(*names).mapInArrow(run, docs.schema)
