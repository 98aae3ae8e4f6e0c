"""Where the visible text of a markup stands in it, as run-length arrays.

A run is a stretch of visible characters that stand one after the other in the markup, or
the characters that one entity stands for. Its arrays are ``at`` (place in the visible
text), ``size``, ``raw`` and ``end`` (its markup) and ``solid`` (an entity, which has no
places inside). All are ascending, so either direction is a binary search, and the size of
a text is linear in its runs, not its characters.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F, types as T

from lexspan.functions.columns import as_col, let
from lexspan.functions.pieces import row_function
from lexspan.functions.text import SEPARATOR_TAGS

_PART = re.compile(r"(?P<none><!--.*?-->|<(?P<name>head|script|style|title)\b[^>]*>.*?</(?P=name)\s*>)"
                   r"|<(?P<tag>/?\s*[A-Za-z][\w:-]*)?[^>]*>?|(?P<entity>&[^;]*;)|(?P<plain>[^<&]+|&)", re.S | re.I)
_WORD = re.compile(r"\S+")


@dataclass
class Spans:
    text: str
    at: np.ndarray
    size: np.ndarray
    raw: np.ndarray
    end: np.ndarray
    solid: np.ndarray
    words: np.ndarray  # place of each word in the text

    @property
    def length(self) -> int:
        return len(self.text)

    def first(self, raw: int) -> int:
        """The first character, no space, that begins at or behind a place in the markup."""
        k = int(np.searchsorted(self.raw, raw, side="left"))  # the first run that begins there or later
        if k and not self.solid[k - 1] and raw < self.end[k - 1]:
            return int(self.at[k - 1] + raw - self.raw[k - 1])
        return int(self.at[k]) if k < len(self.at) else self.length

    def last(self, raw: int) -> int:
        """The end of the last character, no space, that ends at or before a place in the markup."""
        k = int(np.searchsorted(self.raw, raw, side="left")) - 1
        if k >= 0 and self.solid[k] and self.end[k] > raw:  # an entity may have several runs
            k = int(np.searchsorted(self.raw, self.raw[k], side="left")) - 1
        return 0 if k < 0 else int(self.at[k] + min(self.size[k], self.size[k] if self.solid[k] else raw - self.raw[k]))

    def shown(self, start: int, end: int) -> int:
        """Visible characters of a part of the markup, without spaces at its ends."""
        return max(0, self.last(end) - self.first(start))

    def markup_end(self, character: int) -> tuple[int, int]:
        """Where a character ends in the markup, and the first character that ends there."""
        k = int(np.searchsorted(self.at, character, side="right")) - 1
        return (int(self.end[k]), int(self.at[k])) if self.solid[k] else (int(self.raw[k]) + character - int(self.at[k]) + 1, character)


def spans_of(markup: str) -> Spans:
    """Words of the joined visible parts, laid over the parts they come from."""
    shown, raw, ends, solid = [], [], [], []
    for part in _PART.finditer(markup):
        if part["plain"] or part["entity"]:
            text = html.unescape(part[0]) if part["entity"] else part[0]
        elif not part["none"] and (part["tag"] or "").strip("/ \t\r\n").lower() in SEPARATOR_TAGS:
            text = "\n"
        else:
            continue
        shown.append(text)
        raw.append(part.start())
        ends.append(part.end())
        solid.append(not part["plain"])
    joined = "".join(shown)
    begins = np.concatenate([[0], np.cumsum([len(s) for s in shown], dtype=np.int64)]).astype(np.int64)
    found = [(w.start(), w.end()) for w in _WORD.finditer(joined)]
    low, high = (np.array([w[i] for w in found], dtype=np.int64) for i in (0, 1))
    words = np.concatenate([[0], np.cumsum(high - low + 1)]).astype(np.int64)[:-1] if found else np.zeros(0, np.int64)
    # Runs begin where a word begins and where a part begins inside a word.
    word = np.searchsorted(low, begins[:-1], side="right") - 1
    inner = begins[:-1][(word >= 0) & (begins[:-1] < high[word]) & (begins[:-1] > low[word])] if found else begins[:0]
    start = np.unique(np.concatenate([low, inner]))
    of_word = np.searchsorted(low, start, side="right") - 1
    part_no = np.searchsorted(begins, start, side="right") - 1
    # Empty parts share their place with the next one, which is the last of them.
    size = np.minimum(high[of_word], begins[part_no + 1]) - start if found else start
    whole = np.array(solid, dtype=bool)[part_no] if found else np.zeros(0, bool)
    part_raw, part_end = np.array(raw, dtype=np.int64)[part_no] if found else start, np.array(ends, dtype=np.int64)[part_no] if found else start
    run_raw = np.where(whole, part_raw, part_raw + start - begins[part_no]) if found else start
    return Spans(" ".join(joined.split()), words[of_word] + start - low[of_word] if found else start, size, run_raw,
                 np.where(whole, part_end, run_raw + size), whole, words)


MAP = T.StructType([T.StructField("text", T.StringType()), *(T.StructField(n, T.ArrayType(T.IntegerType())) for n in ("at", "raw", "end")),
                    T.StructField("solid", T.ArrayType(T.BooleanType()))])


def _mapped(markup: str | None) -> dict:
    found = spans_of(markup or "")
    return {"text": found.text, "at": found.at, "raw": found.raw, "end": found.end, "solid": found.solid}


_span_map = row_function(MAP, _mapped).asNondeterministic()


def span_map(markup) -> Column:
    """The visible text and its runs: text, at, raw, end, solid."""
    return _span_map(as_col(markup))


def _run_of(at: Column, place: Column) -> Column:
    """Index of the run that holds a place of the text: a binary search over ``at``."""
    def halve(range_: Column, _: Column) -> Column:
        middle = F.shiftright(range_["low"] + range_["high"] + 1, 1)
        below = F.get(at, middle) <= place
        return F.struct(F.when(below, middle).otherwise(range_["low"]).alias("low"),
                        F.when(below, range_["high"]).otherwise(F.greatest(middle - 1, range_["low"])).alias("high"))

    steps = F.sequence(F.lit(1), F.length(F.bin(F.size(at).cast("long"))) + 1)
    return F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.greatest(F.size(at) - 1, F.lit(0)).alias("high")), halve, lambda r: r["low"])


def quote_spans(documents: DataFrame, markup: str, quote: str) -> DataFrame:
    """Adds where a quote of the visible text stands: ``text_start`` (its first place, NULL
    where the quote is empty or absent) and ``source_start``, ``source_end`` in the markup."""
    keys = [c for c in documents.columns if c != markup]
    mapped = documents.select(*keys, span_map(markup).alias("m"))
    found = F.when(F.length(quote) > 0, F.expr(f"locate({quote}, m.text)"))
    located = mapped.withColumn("text_start", F.when(found > 0, found - 1))

    def bound(place: Column, closing: bool) -> Column:
        def edge(run: Column) -> Column:
            inside = F.get(F.col("m.raw"), run) + place - F.get(F.col("m.at"), run)
            return F.when(F.get(F.col("m.solid"), run), F.get(F.col("m.end" if closing else "m.raw"), run)).otherwise(inside + int(closing))

        return let(_run_of(F.col("m.at"), place), edge)

    start = F.col("text_start")
    return located.select(*keys, "text_start", F.when(start.isNotNull(), bound(start, False)).alias("source_start"),
                          F.when(start.isNotNull(), bound(start + F.length(quote) - 1, True)).alias("source_end"))
