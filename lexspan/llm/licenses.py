"""Licence scan (operator 10), DataFrame functions and Spark ML only.

Paragraphs (lines) become sparse counts of words and word pairs; a multinomial logistic
regression names a licence family or ``unknown``. It is fitted on the notices below and on
a bounded sample of distinct paragraphs, which a comparison with the notices labels; each
family and the paragraphs that only mention a licence have rows of their own. An isotonic
fit on the notices and the other paragraphs that were left out turns 1 - P(unknown) into the probability of a licence,
and a prediction stands if that is at least ``MIN_PROBABILITY``; everything else is the
unknown class. Comparison with the family's notices then confirms the prediction.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, NGram, RegexTokenizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, Window, functions as F

from lexspan.llm.common import cut_lineage

UNKNOWN = "unknown"
MIN_PROBABILITY, MIN_SIMILARITY, SURE_SIMILARITY = 0.5, 0.5, 0.8
# Bounds of the sample of distinct paragraphs: those of a family, those that mention a
# licence without being a notice, and others.
FAMILY_ROWS, CUED_ROWS, OTHER_ROWS = 500, 2_000, 4_000
CUE = r"(?i)licen[cs]e|copyright|public domain|creative commons|permission is|without warranty|redistribut"

# Public notices by licence family.
NOTICES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright under CC0 1.0 Universal."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]
FAMILIES = [UNKNOWN, *sorted({family for family, _ in NOTICES})]


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^a-z0-9]+", -1), lambda w: F.length(w) > 0)


def _runs(text: Column) -> Column:
    """Distinct runs of two words; a single word stands for itself."""
    words = _words(text)
    return F.array_distinct(F.when(F.size(words) < 2, words).otherwise(
        F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda k: F.concat_ws(" ", F.slice(words, k, 2)))))


def similarity(runs: Column, family: Column) -> Column:
    """Largest Jaccard similarity of a paragraph's word pairs with a notice of the family."""
    scores = []
    for name, notice in NOTICES:
        words = "".join(c if c.isascii() and c.isalnum() else " " for c in notice.lower()).split()
        pairs = F.array(*[F.lit(f"{a} {b}") for a, b in dict.fromkeys(zip(words, words[1:]))])
        both = F.size(F.array_intersect(runs, pairs))
        scores.append(F.when(family == name, both / (F.size(runs) + F.size(pairs) - both)))
    return F.coalesce(F.greatest(*scores), F.lit(0.0))


def paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, paragraph, body) of every line with something on it; 0 is the first."""
    return (docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(text_col, "\n", -1)).alias("paragraph", "body"))
            .where(F.trim("body") != ""))


def _sampled(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Distinct (body, family) that mention a licence, and distinct (body) that do not."""
    lines = paragraphs(docs, id_col, text_col).select("body")
    order = F.xxhash64(F.lit(31), "body")
    cue, best = F.col("body").rlike(CUE), F.greatest(*[F.struct(similarity(F.col("runs"), F.lit(name)).alias("s"), F.lit(name).alias("family"))
                                                       for name in FAMILIES[1:]])
    # Compared once each: as a table, and as a generator's output, filters stay above them.
    cued = cut_lineage(lines.where(cue).distinct()).select("body", F.inline(F.array(F.struct(_runs(F.col("body")).alias("runs")))))
    cued = cued.select("body", F.inline(F.array(F.struct(best.alias("best")))))
    cued = cut_lineage(cued.where((F.col("best.s") >= SURE_SIMILARITY) | (F.col("best.s") < MIN_SIMILARITY)).select(
        "body", F.when(F.col("best.s") >= SURE_SIMILARITY, F.col("best.family")).otherwise(UNKNOWN).alias("family")))
    place, known = F.row_number().over(Window.partitionBy("family").orderBy(order, "body")), F.col("family") != UNKNOWN
    # Each limit by itself, so that tasks cut their rows before the shuffle.
    cued = (cued.where(known).withColumn("place", place).where(F.col("place") <= FAMILY_ROWS).drop("place")
            .unionByName(cued.where(~known).orderBy(order, "body").limit(CUED_ROWS)))
    # Only hashes are shuffled for the distinct others: their bound, then the lines up to it.
    last = lines.where(~cue).select(order.alias("h")).distinct().orderBy("h").limit(OTHER_ROWS).agg(F.max("h")).first()[0]
    others = lines.where(~cue & (order <= F.lit(last))).distinct() if last is not None else lines.limit(0)
    return cued, others


def _labelled(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    cued, others = _sampled(docs, id_col, text_col)
    fixed = spark.createDataFrame([(notice, family) for family, notice in NOTICES for _ in range(5)], "body string, family string")
    return cued.unionByName(others.withColumn("family", F.lit(UNKNOWN))).unionByName(fixed)


class Classifier:
    """Fitted stages; ``apply`` adds family and probability to paragraphs."""

    def __init__(self, features: PipelineModel, model, calibration):
        self.features, self.model, self.calibration = features, model, calibration

    def _scores(self, rows: DataFrame) -> DataFrame:
        found = self.model.transform(self.features.transform(rows))
        # As a generator's output the scores are made once: filters on them stay above it.
        return found.select(*rows.columns, F.inline(F.array(F.struct(vector_to_array("__probability").alias("__p")))))

    def apply(self, rows: DataFrame) -> DataFrame:
        found = self._scores(rows).withColumn("__licence", 1 - F.get("__p", F.lit(0)))
        known = F.slice("__p", 2, len(FAMILIES) - 1)
        best = F.get(F.array(*[F.lit(f) for f in FAMILIES[1:]]), (F.array_position(known, F.array_max(known)) - 1).cast("int"))
        found = self.calibration.transform(found) if self.calibration else found.withColumn("probability", F.col("__licence"))
        found = found.withColumn("probability", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "probability")))
        family = F.when(F.col("probability") >= MIN_PROBABILITY, best).otherwise(UNKNOWN)
        return found.select(*rows.columns, family.alias("family"), "probability")


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Classifier:
    """Classifier from the notices and a bounded sample of distinct paragraphs."""
    sample = _labelled(docs, id_col, text_col)
    index = F.array_position(F.array(*[F.lit(f) for f in FAMILIES]), F.col("family")) - 1
    sample = sample.withColumn("__label", index.cast("double")).withColumn("__part", F.pmod(F.xxhash64(F.lit(5), "body"), F.lit(4)))
    sample = cut_lineage(sample)
    tokens = RegexTokenizer(inputCol="body", outputCol="__words", pattern="[^a-z0-9]+", toLowercase=True)
    pairs = NGram(n=2, inputCol="__words", outputCol="__pairs")
    both = pairs.transform(tokens.transform(sample.where(F.col("family") != UNKNOWN)))
    vocabulary = sorted(r["g"] for r in both.select(F.explode(F.concat("__words", "__pairs")).alias("g")).distinct().collect())
    words = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="__words", outputCol="__word_counts")
    runs = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="__pairs", outputCol="__pair_counts")
    join = VectorAssembler(inputCols=["__word_counts", "__pair_counts"], outputCol="__features")
    features = PipelineModel([tokens, pairs, words, runs, join])
    regression = LogisticRegression(featuresCol="__features", labelCol="__label", probabilityCol="__probability", rawPredictionCol="__raw",
                                    predictionCol="__prediction", family="multinomial", regParam=0.001, maxIter=60)
    model = regression.fit(features.transform(sample.where("__part > 0 or __label > 0")))
    found = Classifier(features, model, None)
    held = found._scores(sample.where("__part = 0 or __label > 0")).select((1 - F.get("__p", F.lit(0))).alias("__licence"), (F.col("__label") > 0).cast("double").alias("__is"))
    found.calibration = IsotonicRegression(featuresCol="__licence", labelCol="__is", predictionCol="probability").fit(held)
    return found


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, paragraph, family, probability, similarity, confirmed) of every paragraph
    that is taken for a licence notice.

    A null or empty text has no paragraphs. Null ids and repeated rows are scanned like any
    other; equal paragraphs get equal results; an empty table gives no rows and leaves the
    classifier the notices. Other columns are not read.
    """
    found = fit(docs, id_col, text_col).apply(paragraphs(docs, id_col, text_col))
    found = found.where(F.col("family") != UNKNOWN)
    found = found.select("*", F.inline(F.array(F.struct(_runs(F.col("body")).alias("runs"))))).withColumn("similarity", similarity(F.col("runs"), F.col("family")))
    return found.select("doc_id", "paragraph", "family", "probability", "similarity", (F.col("similarity") >= MIN_SIMILARITY).alias("confirmed"))
