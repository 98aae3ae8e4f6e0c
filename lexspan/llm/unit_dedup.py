"""Substring dedup by hashing lines and the sentences in them (operator 3).

Every line with a word on it is a unit, so passages and paragraphs go by their lines,
however short. The sentences in a line are units too if they have enough words, so a passage
repeated within a line is found by its sentences. Units are normalised (lower case, white
space collapsed) and hashed; digests are grouped over all documents, the earliest ranked
occurrence stays, and every other one is a removal with its place in the original text.
Equal lines have equal sentences, so the sentence that stays is never in a line that goes.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

MIN_WORDS = 6
LINE = re.compile(r"[^\n]+\n*")
UNIT = re.compile(r"[^.!?。！？\n]+[.!?。！？\n]*|[.!?。！？\n]+")
# Letters of scripts without spaces between words; two count as a word.
CLOSE = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
UNITS = "doc_id long, tie long, start long, length long, n_words long, digest binary, line long, whole boolean"


def _digest(words: list[str]) -> bytes:
    return hashlib.blake2b(" ".join(words).encode(), digest_size=16).digest()


def _levels(text: str, min_words: int) -> Iterator[tuple[int, int, int, bytes, int, bool]]:
    """Units with the start of their line, and whether they are all its words."""
    plain = text.isascii()
    for line in LINE.finditer(text):
        whole, start = line.group().lower().split(), line.start()
        if not whole:
            continue
        yield start, line.end() - start, len(whole), _digest(whole), start, True
        for match in UNIT.finditer(text, start, line.end()):
            words = match.group().lower().split()
            enough = len(words) >= min_words or not plain and len(CLOSE.findall(match.group())) >= 2 * min_words
            if enough and words != whole:
                yield match.start(), match.end() - match.start(), len(words), _digest(words), start, False


def units_of(text: str, min_words: int) -> Iterator[tuple[int, int, int, bytes]]:
    """(start, length, words, digest), in code points, of the lines and of the sentences with
    enough words that are not all of their line."""
    for unit in _levels(text, min_words):
        yield unit[:4]


def _units(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64()] * 5 + [pa.binary(), pa.int64(), pa.bool_()]
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                out = [(doc_id, tie, *unit) for doc_id, tie, text in zip(*(part.column(k).to_pylist() for k in range(3)), strict=True)
                       if text for unit in _levels(text, min_words)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)],
                                                     [f.split()[0] for f in UNITS.split(", ")])

    return run


def removals(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text",
             nested: bool = True) -> DataFrame:
    """(doc_id, tie, start, length, n_words, first_doc_id, first_start): units to remove;
    ``nested`` says whether the sentences of lines that go whole are among them.

    Occurrences are ranked by id, a hash of the text and place. A null or empty text has no
    units; a null id ranks first; rows that repeat id and text are the same occurrence and
    keep the same units; an empty table gives no rows. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("tie"), F.col(text_col).alias("text"))
    units = rows.mapInArrow(_units(min_words), UNITS)
    place = F.struct("doc_id", "tie", "start")
    groups = units.groupBy("digest").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    gone = units.join(groups.select("digest", "first"), "digest").where(~place.eqNullSafe(F.col("first")))
    if not nested:
        line = F.max("whole").over(Window.partitionBy("doc_id", "tie", "line"))
        gone = gone.withColumn("line_gone", line).where(F.col("whole") | ~F.col("line_gone"))
    return (gone.select("doc_id", "tie", "start", "length", "n_words", F.col("first.doc_id").alias("first_doc_id"),
                    F.col("first.start").alias("first_start")))


def remove(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows and columns of ``docs`` without the removed units; ``removed_spans`` has
    their (start, length) in the original text."""
    spans = (removals(docs, min_words, id_col, text_col, nested=False).groupBy(F.col("doc_id").alias("__id"), F.col("tie").alias("__tie"))
             .agg(F.sort_array(F.collect_set(F.struct("start", "length"))).alias("removed_spans")))
    joined = docs.join(spans, F.col(id_col).cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(text_col) == F.col("__tie")), "left")
    text, found = F.col(text_col), F.col("removed_spans")
    # What stands between one removal and the next.
    kept = F.transform(found, lambda s, k: F.substring(
        text, (F.when(k == 0, 0).otherwise(F.get(found, k - 1)["start"] + F.get(found, k - 1)["length"]) + 1).cast("int"),
        (s["start"] - F.when(k == 0, 0).otherwise(F.get(found, k - 1)["start"] + F.get(found, k - 1)["length"])).cast("int")))
    last = F.element_at(found, -1)
    rest = F.concat(F.array_join(kept, ""), F.substring(text, (last["start"] + last["length"] + 1).cast("int"), F.length(text)))
    return joined.withColumn(text_col, F.when(found.isNotNull(), rest).otherwise(text)).drop("__id", "__tie")
