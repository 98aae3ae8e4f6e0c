"""Language identification (operator 2): known words first, shorter n-grams for the rest.

Words are runs of letters, lower-cased. A word that was learned in some language scores
its log10 relative frequency in every language. Any other word backs off: it takes the
mean over its known character n-grams of the longest order that has one, from four
characters down to one, with the word's edges as characters. Where a language lacks what
another has, it takes a penalty: -7, or half an occurrence where that is less. Scores are
whole millionths, so their sums are the same in any order. The language with the highest
sum wins, ties go to the first in alphabetical order, and the score is its share after
exponentiation.

All words and n-grams of all learning documents are the model, as tables. Tasks are sent
only its most frequent words, at most ``SENT_SCORES`` scores whatever the number of
languages; the other words of a text stay in its row, and each distinct one is looked up
once by joins: in the table of words, then, order by order, in the tables of n-grams.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lexspan.llm.common import cut_lineage

ORDERS = (4, 3, 2, 1)
PENALTY, SCALE = -7.0, 1_000_000
# Words sent to tasks, and scores (a word has one for each language): bounds of a broadcast only.
SENT_WORDS, SENT_SCORES = 250_000, 8_000_000

_LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    return _LETTERS.findall(text.lower()) if text else []


def has_letter(words: list[str]) -> bool:
    """The word pattern also takes number signs such as ½, which are no letters."""
    return any(ch.isalpha() for word in words for ch in word)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        by_language: dict[str, Counter] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
            by_language.setdefault(lang, Counter()).update(words_of(text.as_py()))
        for lang, counter in by_language.items():
            if counter:
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counter)), pa.array(list(counter)),
                                                  pa.array(list(counter.values()), pa.int64())], ["lang", "gram", "n"])


def _grams(word: str, size: int) -> Column:
    """N-grams of a word between its edges, in order and with repeats."""
    padded = F.concat(F.lit(" "), F.col(word), F.lit(" "))
    count = F.length(padded) - (size - 1)
    return F.transform(F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>")), lambda at: F.substring(padded, at, F.lit(size)))


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], DataFrame]:
    """(languages in order, table of (size, gram, n, scores)): all words (size 0) and n-grams
    with their scores by language. Rows of the totals, a few per language, pass the driver."""
    rows = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    counted = cut_lineage(rows.mapInArrow(_count_words, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    each = [(0, F.lit(1)), *((size, F.greatest(F.lit(0), F.length("gram") + 2 - (size - 1))) for size in ORDERS)]
    totals = counted.groupBy("lang").agg(*[F.sum(F.col("n") * number).alias(f"total_{size}") for size, number in each]).orderBy("lang").collect()
    languages = [row["lang"] for row in totals]

    def sized(size: int) -> Column:
        # A function of its own: a second parameter of the lambda would be the position.
        return F.transform(_grams("gram", size), lambda gram: F.struct(F.lit(size).alias("size"), gram.alias("gram")))

    parts = [F.array(F.struct(F.lit(0).alias("size"), F.col("gram"))), *map(sized, ORDERS)]
    sums = (counted.select("lang", "n", F.explode(F.concat(*parts)).alias("x")).groupBy("x.size", "x.gram", "lang").agg(F.sum("n").alias("n"))
            .groupBy("size", "gram").agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by")))

    def score(row, size: int) -> Column:
        total = float(max(row[f"total_{size}"], 1))
        seen = F.round(F.log10(F.col("by")[row["lang"]] / F.lit(total)) * SCALE).cast("long")
        return F.coalesce(seen, F.lit(round(min(PENALTY, float(np.log10(0.5 / total))) * SCALE)).cast("long"))

    scores = None
    for size, _ in each:
        values = F.array(*[score(row, size) for row in totals])
        scores = F.when(F.col("size") == size, values) if scores is None else scores.when(F.col("size") == size, values)
    return languages, cut_lineage(sums.select("size", "gram", "n", (scores if languages else F.array().cast("array<bigint>")).alias("scores")))


def _sent(table: DataFrame, languages: int) -> tuple[dict[str, int], np.ndarray]:
    """The most frequent words and their scores, no more than the bounds allow."""
    words = table.where("size = 0").withColumn("step", F.floor(F.log2("n") * 8))
    least, sent = 1 << 20, 0
    for step, n in words.groupBy("step").count().orderBy(F.desc("step")).collect():  # some hundred rows
        sent += n
        if sent > min(SENT_WORDS, SENT_SCORES // languages):
            break
        least = step
    rows = words.where(F.col("step") >= least).select("gram", "scores").toArrow()
    return {word: k for k, word in enumerate(rows["gram"].to_pylist())}, np.array(rows["scores"].to_pylist(), dtype=np.int64).reshape(-1, languages)


FIRST = "doc_id long, letters boolean, total array<bigint>, rest array<struct<word:string,n:bigint>>"


def _score_sent(held, languages: int):
    """Sums over the words that tasks know, and the other words of each text with counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, scores = held.value
        for batch in batches:
            letters, totals, rest = [], [], []
            for text in batch.column("text"):
                words = words_of(text.as_py())
                letters.append(has_letter(words))
                counts = Counter(words) if letters[-1] else {}
                found = [w for w in counts if w in known]
                sums = np.array([counts[w] for w in found], dtype=np.int64) @ scores[[known[w] for w in found]] if found else np.zeros(languages, np.int64)
                totals.append(sums.tolist())
                rest.append([{"word": w, "n": n} for w, n in counts.items() if w not in known])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(letters, pa.bool_()), pa.array(totals, pa.list_(pa.int64())),
                 pa.array(rest, pa.list_(pa.struct([("word", pa.string()), ("n", pa.int64())])))], ["doc_id", "letters", "total", "rest"])

    return run


def word_scores(words: DataFrame, table: DataFrame, languages: int) -> DataFrame:
    """(word, scores) of distinct words: their own, or the mean of their known n-grams of the
    longest order that has one. A word without any known n-gram has no row."""
    own = table.where("size = 0").select(F.col("gram").alias("word"), "scores")
    found, left = words.join(own, "word"), cut_lineage(words.join(own.select("word"), "word", "left_anti"))
    for size in ORDERS:
        grams = table.where(F.col("size") == size).select("gram", "scores")
        means = (left.select("word", F.explode(_grams("word", size)).alias("gram")).join(grams, "gram").groupBy("word").agg(
            F.array(*[F.round(F.sum(F.get("scores", F.lit(k))) / F.count(F.lit(1))).cast("long") for k in range(languages)]).alias("scores")))
        means = cut_lineage(means)
        found = found.unionByName(means)
        left = left.join(means.select("word"), "word", "left_anti")
    return found


def identify(docs: DataFrame, learning: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, lang_pred, score) of every document of ``docs``; ``learning`` has the texts
    and languages to learn from.

    A null text, or one without a letter, is ``und`` with score 0; so is every text when
    nothing was learned. Rows with a null language are not learned from. A text none of
    whose letters are known takes the first language with an even score. Repeated rows
    count as often as they occur and get equal results; an empty table gives no rows. Only
    the text decides; other columns are not read.
    """
    languages, table = learn(learning, text_col, lang_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if not languages:
        return rows.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    held = docs.sparkSession.sparkContext.broadcast(_sent(table, len(languages)))
    # A written table, so that the numbers of the rows stay as they are.
    first = cut_lineage(rows.mapInArrow(_score_sent(held, len(languages)), FIRST).withColumn("row", F.monotonically_increasing_id()))
    rest = first.select("row", F.explode("rest").alias("x")).select("row", "x.word", "x.n")
    scored = rest.join(word_scores(rest.select("word").distinct(), table, len(languages)), "word")
    more = scored.groupBy("row").agg(F.array(*[F.sum(F.col("n") * F.get("scores", F.lit(k))) for k in range(len(languages))]).alias("more"))
    total = F.zip_with("total", F.coalesce("more", F.array_repeat(F.lit(0).cast("long"), len(languages))), lambda a, b: a + b)
    summed = first.join(more, "row", "left").select("doc_id", "letters", total.alias("total")).withColumn("best", F.array_max("total"))
    share = 1 / F.aggregate("total", F.lit(0.0), lambda s, x: s + F.pow(F.lit(10.0), (x - F.col("best")) / SCALE))
    named = F.element_at(F.array(*[F.lit(name) for name in languages]), F.array_position("total", F.col("best")).cast("int"))
    return summed.select("doc_id", F.when(F.col("letters"), named).otherwise("und").alias("lang_pred"), F.when(F.col("letters"), share).otherwise(0.0).alias("score"))


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds; a null id counts as empty text."""
    return F.crc32(F.encode(F.coalesce(F.col(id_col).cast("string"), F.lit("")), "utf-8")) % folds
